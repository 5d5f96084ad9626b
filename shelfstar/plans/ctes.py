"""The star as ANSI SQL common table expressions, used only to check results.

A check query names the tables it needs; ``with_tables`` puts their definitions in front.
The stock walk is written here as a recursion over the sale lines of a position, while the
Spark jobs work from daily totals, so the two derivations check each other.
"""

from __future__ import annotations

import re

from shelfstar.star import (ACQUISITION, BOTTOM_SIZES, CATEGORIES, CHANNELS, DEFAULT_TAX, DEFAULT_ZONE, OPENING,
                            PREFERRED, SEASONS, STATES, STATE_TAX, TIME_ZONE, TOP_SIZES)


def pick(values: list, index: str) -> str:
    return "(case " + " ".join(f"when {index} = {i} then '{v}'" for i, v in enumerate(values)) + " end)"


def dkey(d: str) -> str:
    return f"cast(year({d}) * 10000 + month({d}) * 100 + day({d}) as int)"


_state = pick(STATES, f"(s_nationkey % {len(STATES)})")
_tax = " ".join(f"when {_state} = '{s}' then {r}" for s, r in STATE_TAX.items())
_zone = " ".join(f"when r_name = '{r}' then '{z}'" for r, z in TIME_ZONE.items())
_chan = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in row) + ")"
                  for row in CHANNELS)
_line_order = "transaction_id, line_number, quantity, net_cents, discount_cents, tax_cents, is_return"

TABLES: dict[str, str] = {
    "horizon": "select cast(max(l_shipdate) as date) as d, cast(min(l_shipdate) as date) as d0 from lineitem",
    "geo": "select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey",
    "customer_d": f"""
        select c_custkey as customer_key, 'CUST_' || c_custkey as customer_id,
          'customer' || c_custkey || '@example.com' as email, c_mktsegment as segment,
          cast(floor(c_acctbal * 100 + 0.5) as bigint) as ltv_cents,
          date '1994-01-01' + cast(c_custkey % 365 as int) as acquisition_date,
          {pick(ACQUISITION, 'c_custkey % 7')} as acquisition_channel,
          {pick(PREFERRED, 'c_custkey % 4')} as preferred_channel,
          {pick(CATEGORIES, 'c_custkey % 8')} as preferred_category,
          {pick(TOP_SIZES, 'c_custkey % 6')} as size_profile_tops,
          {pick(BOTTOM_SIZES, 'c_custkey % 8')} as size_profile_bottoms,
          r_name as geo_region, n_name as geo_city, c_custkey % 10 as nearest_store_id,
          case when c_acctbal >= 7500 then 'platinum' when c_acctbal >= 5000 then 'gold'
               when c_acctbal >= 2500 then 'silver' else 'bronze' end as loyalty_tier,
          c_custkey % 3 <> 0 as email_subscribe_flag, c_custkey % 5 = 0 as sms_subscribe_flag,
          date '1994-01-01' + cast(c_custkey % 365 as int) as effective_date,
          date '9999-12-31' as expiration_date, true as is_current
        from customer join geo on c_nationkey = n_nationkey""",
    "product_d": f"""
        select p_partkey as product_key, 'PROD_' || p_partkey as product_id, p_name as product_name, p_brand as brand,
          p_type as category_level_1, split_part(p_name, ' ', -1) as category_level_2,
          split_part(p_name, ' ', 1) as category_level_3,
          case when p_type in ('SMALL', 'MEDIUM', 'LARGE') then 'XS-XL' else 'ONE SIZE' end as size_range,
          {pick(SEASONS, 'p_partkey % 4')} as season_code,
          date '1995-01-01' + cast(p_partkey % 730 as int) as launch_date,
          case when p_partkey % 5 = 0 then date '2001-11-04' + cast(30 + p_partkey % 336 as int) end as end_of_life_date,
          cast(floor(p_retailprice * 100 + 0.5) as bigint) as price_cents,
          cast(floor(p_retailprice * 100 + 0.5) as bigint) * 2 // 5 as unit_cost_cents,
          case when p_retailprice > 975 then 'luxury' when p_retailprice > 950 then 'premium'
               when p_retailprice > 925 then 'mid' else 'budget' end as price_tier,
          p_partkey % 10 <> 9 as product_active
        from part""",
    "location_d": f"""
        select s_suppkey as location_key, 'LOC_' || s_suppkey as location_id, s_name as location_name,
          case when s_suppkey % 13 < 10 then 'store' when s_suppkey % 13 < 12 then 'warehouse' else 'dc' end as location_type,
          n_name as city, {_state} as state_province, r_name as region,
          case when s_suppkey % 13 < 10 then 'physical' else 'digital' end as location_channel,
          'District_' || upper(substr(r_name, 1, 2)) as district,
          case {_zone} else '{DEFAULT_ZONE}' end as timezone,
          case {_tax} else {DEFAULT_TAX} end as tax_rate_e5,
          5000 + s_suppkey * 37 % 100 * 100 as selling_sqft,
          (5000 + s_suppkey * 37 % 100 * 100) * 3 // 2 as total_sqft,
          s_suppkey % 29 <> 28 as location_active
        from supplier join geo on s_nationkey = n_nationkey""",
    "channel_d": f"""
        select * replace (cast(commission_rate as double) as commission_rate) from (values {_chan}) as t(channel_key, channel_code, channel_name, channel_type, channel_category,
          device_category, is_digital, is_owned, commission_rate)""",
    "lines": f"""
        select l_orderkey as transaction_id, l_linenumber as line_number, l_partkey as product_key,
          l_suppkey as location_key, cast(l_shipdate as date) as day, {dkey('l_shipdate')} as date_key,
          cast(l_orderkey % 8 + 1 as int) as channel_key, cast(l_quantity as int) as quantity,
          cast(floor(l_extendedprice * (1 - l_discount) * 100) as bigint) as net_cents,
          cast(floor(l_extendedprice * l_discount * 100) as bigint) as discount_cents,
          cast(floor(cast(floor(l_extendedprice * (1 - l_discount) * 100) as bigint) * l_tax) as bigint) as tax_cents,
          cast(floor(l_extendedprice * (1 - l_discount) * 100) as bigint)
            - cast(floor(l_extendedprice * 0.4 * 100) as bigint) as margin_cents,
          cast(floor(l_extendedprice * 0.4 * 100) as bigint) as cost_cents,
          l_returnflag = 'R' as is_return
        from lineitem""",
    "sales": "select l.*, o_custkey as customer_key from lines l join orders on o_orderkey = transaction_id",
    "events_f": f"""
        select event_id, ts, 'SESSION_' || user_id || '_' || {dkey('ts - interval 8123 day')} as session_id,
          user_id as customer_key, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as product_key,
          cast(ts as date) - 8123 as day, {dkey('ts - interval 8123 day')} as date_key,
          cast(hour(ts) * 100 + minute(ts) // 15 * 15 as int) as time_key,
          cast((user_id + date_diff('day', date '1970-01-01', cast(ts as date) - 8123)) % 4 + 1 as int) as channel_key,
          case event_type when 'view' then 'product_view' when 'click' then 'add_to_cart'
            when 'signup' then 'checkout_start' when 'purchase' then 'checkout_complete' else event_type end as event_type,
          case when event_type = 'view' then 'engagement' when event_type in ('signup', 'purchase') then 'conversion'
            else 'interaction' end as event_category,
          case when event_type in ('click', 'purchase') then cast(floor(value * 100) as bigint) else 0 end as event_cents,
          case when event_type = 'view' then 5 + event_id % 296 else 0 end as time_on_page,
          event_type = 'purchase' as conversion_flag
        from events""",
    "requested": """
        select product_key, location_key, day, 1 as kind, transaction_id, line_number, quantity, net_cents,
               discount_cents, tax_cents, is_return, 0 as restock, quantity as request, -quantity as x from lines
        union all
        select product_key, location_key, day + cast(1 + transaction_id % 3 as int), 0, transaction_id, line_number,
               quantity, net_cents, discount_cents, tax_cents, is_return, quantity, 0, quantity from lines where is_return""",
    "line_sum": f"""
        select *, {OPENING} as opening,
          {OPENING} + sum(x) over w as level,
          row_number() over w as seq
        from requested
        window w as (partition by product_key, location_key order by day, kind, {_line_order}
                     rows unbounded preceding)""",
    "line_walk": """
        select *, cast(level - least(0, min(level) over (partition by product_key, location_key order by seq
                  rows unbounded preceding)) as bigint) as stock_after
        from line_sum""",
    "requested_days": """
        select product_key, location_key, day, any_value(opening) as opening, cast(sum(restock) as bigint) as restock,
          cast(sum(request) as bigint) as request, count(*) filter (where kind = 1) as attempts,
          arg_max(stock_after, seq) as stock_end
        from line_walk group by 1, 2, 3""",
    "requested_walk": """
        select *, coalesce(lag(stock_end) over (partition by product_key, location_key order by day), opening) + restock as stock_start
        from requested_days""",
    "numbered": f"""
        select *, {OPENING} as opening, day + cast(1 + transaction_id % 3 as int) as due,
          row_number() over (partition by product_key, location_key order by day, {_line_order}) as n
        from lines""",
    "replay": """
        select product_key, location_key, n, opening as stock_before, least(quantity, opening) as allocated,
          opening - least(quantity, opening) as stock,
          case when is_return then [{'due': due, 'back': least(quantity, opening)}] else [] end as owed
        from numbered where n = 1
        union all
        select product_key, location_key, n, s, least(quantity, s), s - least(quantity, s),
          list_concat(later, case when is_return then [{'due': due, 'back': least(quantity, s)}] else [] end)
        from (select m.*, list_filter(owed, lambda x: x.due > m.day) as later,
                cast(stock + coalesce(list_sum([x.back for x in owed if x.due <= m.day]), 0) as bigint) as s
              from replay r join numbered m on m.product_key = r.product_key and m.location_key = r.location_key and m.n = r.n + 1) t""",
    "alloc": """
        select transaction_id, line_number, product_key, location_key, day, due, quantity, net_cents, is_return, opening,
          stock_before, allocated, allocated < quantity as is_constrained
        from numbered join replay using (product_key, location_key, n)""",
    "walk0": """
        select *, cast(opening + sum(restock - given) over (partition by product_key, location_key order by day) as bigint) as stock_end
        from (select product_key, location_key, day, any_value(opening) as opening, cast(sum(restock) as bigint) as restock,
                cast(sum(request) as bigint) as request, cast(sum(attempt) as bigint) as attempts, sum(given) as given
              from (select product_key, location_key, opening, day, 0 as restock, quantity as request, 1 as attempt, allocated as given from alloc
                    union all
                    select product_key, location_key, opening, due, allocated, 0, 0, 0 from alloc where is_return and allocated > 0) e
              group by 1, 2, 3) t""",
    "walk": """
        select *, coalesce(lag(stock_end) over w, opening) as stock_prev,
          coalesce(lag(stock_end) over w, opening) + restock as stock_start,
          lead(day) over w as next_day,
          cast(sum(request) over (partition by product_key, location_key) as bigint) as units_total,
          cast(count(*) filter (where request > 0) over (partition by product_key, location_key) as bigint) as selling_days
        from walk0 window w as (partition by product_key, location_key order by day)""",
    "inv": """
        select product_key, location_key, d as day, year(d) * 10000 + month(d) * 100 + day(d) as date_key, stock as quantity_on_hand, stock as quantity_available,
          cast(0 as bigint) as quantity_reserved, cast(0 as bigint) as quantity_damaged, in_transit as quantity_in_transit,
          stock = 0 as is_stockout,
          case when stock = 0 and since is not null then date_diff('day', since, d) else 0 end as stockout_days,
          stock * selling_days // units_total as days_of_supply,
          (stock + in_transit) * selling_days // units_total as stock_cover_days,
          units_total * 2 // selling_days as reorder_point, units_total * 5 // selling_days as reorder_quantity,
          stock * selling_days // units_total > 60 as is_overstock, last_restock as last_replenishment_date,
          coalesce(next_restock, case when stock = 0 then d + cast(1 + (product_key + location_key) % 10 as int) end)
            as next_replenishment_date, units_total, selling_days
        from (select product_key, location_key, d, arg_max(stock_end, day) filter (where day <= d) as stock,
                cast(coalesce(sum(restock) filter (where day > d), 0) as bigint) as in_transit,
                max(day) filter (where day <= d and stock_start > 0 and stock_end = 0 and request > 0) as since,
                max(day) filter (where day <= d and restock > 0) as last_restock,
                min(day) filter (where day > d and restock > 0) as next_restock,
                any_value(units_total) as units_total, any_value(selling_days) as selling_days
              from walk cross join horizon group by 1, 2, 3) as t""",
    "periods": """
        select product_key, location_key, day as start_day,
          (select min(r.day) from walk r where r.product_key = s.product_key and r.location_key = s.location_key
             and r.day > s.day and r.restock > 0) as end_day
        from walk s where stock_start > 0 and stock_end = 0 and request > 0""",
    "avg_daily": """
        select product_key, location_key, sum(n) as attempts_total, sum(q) as units_total, count(*) as selling_days
        from (select product_key, location_key, day, count(*) as n, sum(quantity) as q from lines group by 1, 2, 3) t
        group by 1, 2""",
    "stockouts": f"""
        select product_key, location_key, start_day as day, end_day, {dkey('start_day')} as start_date_key,
          {dkey('end_day')} as end_date_key, days as duration_days, peak as peak_season_flag,
          case when peak then attempts * 3 // 2 else attempts end as lost_attempts,
          case when peak then units * 3 // 2 else units end as lost_units,
          case when peak then units * coalesce(price_cents, 5000) * 3 // 2
               else units * coalesce(price_cents, 5000) end as lost_cents
        from (select p.*, date_diff('day', start_day, end_day) + 1 as days, price_cents,
                cast(attempts_total * (date_diff('day', start_day, end_day) + 1) // selling_days as bigint) as attempts,
                cast(units_total * (date_diff('day', start_day, end_day) + 1) // selling_days as bigint) as units,
                exists (select 1 from generate_series(start_day, end_day, interval 1 day) g(x) where month(x) in (11, 12)) as peak
              from periods p join avg_daily using (product_key, location_key)
              left join product_d using (product_key) where end_day <= (select d from horizon)) t""",
    "affinity_0": """
        select coalesce(s.customer_key, e.customer_key) as customer_key, coalesce(s.product_key, e.product_key) as product_key,
          coalesce(p, 0) as purchase_count, coalesce(spent, 0) as spent, coalesce(v, 0) as view_count,
          coalesce(c, 0) as cart_add_count, greatest(coalesce(sd, ed), coalesce(ed, sd)) as last_day
        from (select customer_key, product_key, count(distinct transaction_id) as p, cast(sum(net_cents) as bigint) as spent,
                max(day) as sd from sales where not is_return group by 1, 2) s
        full outer join (select customer_key, product_key, count(*) filter (where event_type = 'product_view') as v,
                count(*) filter (where event_type = 'add_to_cart') as c, max(day) as ed
              from events_f group by 1, 2) e
          on s.customer_key = e.customer_key and s.product_key = e.product_key""",
    "affinity": """
        select customer_key, product_key, purchase_count, view_count, cart_add_count,
          least(100, 5 * purchase_count + 3 * cart_add_count + 2 * view_count) as score_pct,
          date_diff('day', last_day, (select d from horizon)) as days_since_last_interaction,
          case when view_count > 0 then purchase_count / view_count else 0e0 end as view_to_purchase_ratio,
          case when cart_add_count > 0 then purchase_count / cart_add_count else 0e0 end as cart_to_purchase_ratio,
          (spent * (10 + least(10, purchase_count)) + 5) // 10 as predicted_cents
        from affinity_0 where purchase_count > 0 or view_count > 5 or cart_add_count > 0""",
    "cart_items": """
        select customer_key, product_key, day, event_cents, customer_key % 10 as location_key
        from events_f where event_type = 'add_to_cart'""",
    "cart_stock": f"""
        select i.*, coalesce(w.stock_end, {OPENING.replace('product_key', 'i.product_key').replace('location_key', 'i.location_key')}) as stock
        from cart_items i asof left join (select product_key, location_key, day, stock_end from walk) w
          on i.product_key = w.product_key and i.location_key = w.location_key and i.day >= w.day""",
    "carts": f"""
        select 'CART_' || customer_key || '_' || {dkey('day')} as cart_id, customer_key, day, {dkey('day')} as date_key,
          channel_key, cart_cents, items_count, minutes_in_cart, stage as abandonment_stage, low_items as inventory_constrained_items,
          low_items > 0 as low_inventory_trigger, sent as recovery_email_sent, opened as recovery_email_opened,
          clicked as recovery_email_clicked, back as is_recovered,
          case when back then day + cast(1 + (customer_key + n) % 7 as int) end as recovery_day,
          case when back then cart_cents * (70 + (customer_key * 3 + n) % 31) // 100 else 0 end as recovered_cents,
          case when low_items > 0 and (customer_key + n) % 10 < 7 then 'low_inventory'
            else {pick(['high_shipping', 'price_concern', 'comparison_shopping', 'technical_issue', 'payment_issue'], '((customer_key + n) % 5)')}
          end as suspected_reason
        from (select *, sent and (customer_key * 11 + n * 17) % 10 < 4 as opened,
                sent and (customer_key * 11 + n * 17) % 10 < 4 and (customer_key * 19 + n * 23) % 10 < 3 as clicked,
                sent and (customer_key * 11 + n * 17) % 10 < 4 and (customer_key * 19 + n * 23) % 10 < 3
                  and (customer_key + n) % 4 = 0 as back
              from (select s.*, date_diff('day', date '1970-01-01', s.day) as n,
                      (customer_key * 7 + date_diff('day', date '1970-01-01', s.day) * 13) % 10 < 8 as sent
                    from (select e.customer_key, e.day, min(channel_key) as channel_key,
                            cast(sum(event_cents) filter (where event_type = 'add_to_cart') as bigint) as cart_cents,
                            count(*) filter (where event_type = 'add_to_cart') as items_count,
                            cast(floor((epoch_us(max(ts)) - epoch_us(min(ts) filter (where event_type = 'add_to_cart'))) / 60000000) as bigint) as minutes_in_cart,
                            case when count(*) filter (where event_type = 'checkout_start') > 0 then 'payment'
                                 when count(*) filter (where event_type = 'error') > 0 then 'shipping' else 'cart' end as stage
                          from events_f e group by 1, 2
                          having count(*) filter (where event_type = 'add_to_cart') > 0
                             and count(*) filter (where event_type = 'checkout_complete') = 0) s) t) u
          left join (select customer_key, day, count(*) filter (where stock <= 5) as low_items from cart_stock group by 1, 2) k
            using (customer_key, day)""",
    "moves": """
        select 'sale' as movement_type, product_key, location_key as from_location_key, cast(null as bigint) as to_location_key,
          day, quantity, cost_cents // quantity as unit_cents, cost_cents // quantity * quantity as total_cents, transaction_id from lines
        union all
        select 'return', product_key, null, location_key, day, quantity, cost_cents // quantity,
          cost_cents // quantity * quantity, transaction_id from lines where is_return
        union all
        select 'transfer', product_key, 10 + product_key % 2, location_key, day + cast(1 + transaction_id % 3 as int), quantity,
          cost_cents // quantity, cost_cents // quantity * quantity, transaction_id from lines where is_return
        union all
        select 'adjustment', product_key, location_key, location_key, day, 1, cost_cents // quantity, cost_cents // quantity,
          transaction_id from lines where transaction_id % 50 = 0
        union all
        select 'receipt', product_key, null, location_key, (select d0 from horizon), opening, c, c * opening, t
        from (select product_key, location_key, min(cost_cents // quantity) as c, min(transaction_id) as t,
                """ + OPENING + """ as opening from lines group by 1, 2) r""",
    "forecast_0": """
        select product_key, location_key, day, cast(sum(quantity) as bigint) as actual_quantity,
          cast(sum(net_cents) as bigint) as actual_cents from lines group by 1, 2, 3""",
    "forecast_1": """
        select product_key, location_key, day, actual_quantity, actual_cents,
          cast(coalesce(sum(actual_quantity) over w // count(*) over w, 25) as bigint) as forecast_quantity
        from forecast_0
        window w as (partition by product_key, location_key order by day rows between unbounded preceding and 1 preceding)
        union all
        select product_key, location_key, (select d + 1 from horizon), null, null, cast(sum(actual_quantity) // count(*) as bigint)
        from forecast_0 group by 1, 2""",
    "forecast": f"""
        select *, {dkey('day')} as date_key, forecast_quantity * 4 // 5 as confidence_lower, forecast_quantity * 6 // 5 as confidence_upper,
          case when actual_quantity is null then null when actual_quantity = 0 then 0e0
               else abs(forecast_quantity - actual_quantity) / actual_quantity * 100e0 end as mape,
          case when actual_quantity is null then null
               when actual_quantity = 0 then case when forecast_quantity = 0 then 100e0 else 0e0 end
               else greatest(0e0, 100e0 - abs(forecast_quantity - actual_quantity) / actual_quantity * 100e0) end as forecast_accuracy,
          case when actual_quantity is null then null when actual_quantity = 0 then 0e0
               else (forecast_quantity - actual_quantity) / actual_quantity * 100e0 end as bias
        from forecast_1""",
    "sizefit_0": f"""
        select s.customer_key, s.product_key, transaction_id, line_number, is_return as is_returned,
          p_size % 6 as size_ix, {pick(TOP_SIZES, '(p_size % 6)')} as ordered_size,
          case line_number % 7 when 0 then 'too_small' when 1 then 'too_large' else 'perfect' end as fit_description
        from sales s join part on p_partkey = product_key""",
    "sizefit": f"""
        select customer_key, product_key, ordered_size,
          case when fit_description <> 'perfect' and is_returned then null else ordered_size end as kept_size,
          case fit_description when 'too_small' then {pick(TOP_SIZES, 'least(size_ix + 1, 5)')}
            when 'too_large' then {pick(TOP_SIZES, 'greatest(size_ix - 1, 0)')} else ordered_size end as recommended_size,
          cast(case fit_description when 'perfect' then 4 when 'too_small' then 1 else 2 end + transaction_id % 2 as bigint) as fit_score,
          fit_description, is_returned,
          case when not is_returned then null when fit_description <> 'perfect' then 'fit_issue_' || fit_description
            else {pick(['changed_mind', 'found_better_price', 'quality_issue'], '(transaction_id % 3)')} end as return_reason
        from sizefit_0""",
    "inv_steps": """
        select product_key, day, stock_end as new, stock_prev as old, units_total, selling_days, 0 as first from walk
        union all
        select product_key, (select d0 from horizon), any_value(opening), 0, any_value(units_total), any_value(selling_days), 1
        from walk group by product_key, location_key""",
    "inv_change": """
        select s.day, sum(first) as positions, sum(new - old) as q, sum((new - old) * unit_cost_cents) as c,
          sum(case when new = 0 then 1 else 0 end - case when old = 0 and first = 0 then 1 else 0 end) as z,
          sum(case when new * selling_days // units_total > 60 then 1 else 0 end
              - case when old * selling_days // units_total > 60 then 1 else 0 end) as o,
          sum(new * selling_days // units_total - old * selling_days // units_total) as s
        from inv_steps s join product_d using (product_key) group by 1""",
    "inv_daily": """
        select c.day, (select count(distinct product_key) from walk) as product_count,
          cast(sum(positions) over w as bigint) as positions, cast(sum(q) over w as bigint) as quantity_available,
          cast(sum(c) over w as bigint) as cost_cents, cast(sum(z) over w as bigint) as stockouts,
          cast(sum(o) over w as bigint) as overstocks, cast(sum(s) over w as bigint) as supply_days
        from (select cast(x as date) as day from horizon, unnest(generate_series(d0, d, interval 1 day)) as g(x)) c
        left join inv_change using (day) window w as (order by c.day rows unbounded preceding)""",
}


def with_tables(sql: str) -> str:
    """Put the definitions of all tables that ``sql`` needs in front of it."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(TABLES[name])

    visit(sql)
    parts = [f"{n} as ({body.strip()})" for n, body in TABLES.items() if n in need]
    text = sql.strip()
    if not parts:
        return text
    if text.lower().startswith("with "):
        return "with recursive " + ",\n".join(parts) + ",\n" + text[5:]
    return "with recursive " + ",\n".join(parts) + "\n" + text
