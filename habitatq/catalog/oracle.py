"""The same queries in SQL, written row by row and independently of the Spark plans."""

from __future__ import annotations

import re

from habitatq.functions import binomial, permute
from habitatq.plans.resampling import poisson_cutoffs

RUNS, POISSON_RUNS, PERMUTATIONS = 100, 100, 1000
SEED = 19
TAXA = ["economy_10m2", "promo_10m2", "standard_10m2", "small_10m2", "medium_10m2", "large_10m2"]
SPECIES = "('ECONOMY','PROMO','STANDARD','SMALL','MEDIUM')"
NEWTON_STEPS = 12


def _let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _double(x: float) -> str:
    return f"({x!r}e0)"


def _unit(text: str, first: int = 1) -> str:
    return f"((('0x' || substr({text}, {first}, {binomial.UNIT_DIGITS}))::bigint + 5e-1) / {16**binomial.UNIT_DIGITS}e0)"


def _tail(k: str) -> str:
    x = f"({k} + 1e0)"
    near = ", ".join(_double(c) for c in binomial.STIRLING_TAIL)
    return f"(case when {k} < 10 then [{near}][{k} + 1] else (1e0/12 - (1e0/360 - 1e0/1260/({x}*{x}))/({x}*{x}))/{x} end)"


def _binomial(n: str, part: str, whole: str, text) -> str:
    """Number of ``n`` draws that fall into ``part`` of ``whole``; ``text(j)`` is the hash of attempt j."""
    h = {k: _double(v) for k, v in binomial.HAT.items()}
    waits = f"""list_reduce(range(0, least({n}, ceil({n}*p + 12*sqrt({n}*p) + 20)::bigint)), lambda s, i: case when s.u < s.f then s
        else {{'u': s.u - s.f, 'f': s.f*(p/(1 - p)*({n} - s.k)/(s.k + 1)), 'k': s.k + 1}} end,
        {{'u': {_unit(text("1"))}, 'f': exp({n}*ln(1 - p)), 'k': 0::bigint}}).k"""
    at = f"""({n} + 1)*ln(({n} - c.m + 1)/({n} - x.k + 1e0)) + (x.k + 5e-1)*ln(c.r*({n} - x.k + 1)/(x.k + 1)) - {_tail("x.k")} - {_tail(f"({n} - x.k)")}"""
    verdict = f"""case when x.us >= {h["squeeze"]} and x.v <= c.v then x.k when x.k >= 0 and x.k <= {n}
        then case when ln(x.v*c.alpha/(c.a/(x.us*x.us) + c.b)) <= c.top + {at} then x.k end end"""
    spot = _let("t.u", "u", f"{{'us': 5e-1 - abs(u), 'k': floor((2*c.a/(5e-1 - abs(u)) + c.b)*u + ({n}*p + 5e-1))::bigint, 'v': t.v}}")
    tried = _let(_let(_let(text("j"), "w", f"{{'u': {_unit('w')} - 5e-1, 'v': {_unit('w', 17)}}}"), "t", spot), "x", verdict)
    search = f"""coalesce(list_reduce(range(1, {binomial.ATTEMPTS + 1}), lambda got, j: coalesce(got, {tried}), null::bigint), c.m)"""
    hat = f"""{{'a': {h["a0"]} + {h["a1"]}*g.b + {h["a2"]}*p, 'b': g.b, 'm': g.m, 'r': g.r, 'v': {h["v0"]} - {h["v1"]}/g.b,
        'alpha': ({h["alpha0"]} + {h["alpha1"]}/g.b)*g.sd, 'top': (g.m + 5e-1)*ln((g.m + 1)/(g.r*({n} - g.m + 1))) + {_tail("g.m")} + {_tail(f"({n} - g.m)")}}}"""
    first = f"""{{'b': {h["b0"]} + {h["b1"]}*sd, 'sd': sd, 'm': floor(({n} + 1)*p)::bigint, 'r': p/(1 - p)}}"""
    rejects = _let(_let(_let(f"sqrt({n}*p*(1 - p))", "sd", first), "g", hat), "c", search)
    few = f"least({part}, {whole} - {part})"
    drawn = _let(f"{few}::double/{whole}", "p", f"case when {n}*p < {binomial.FEW}e0 then {waits} else {rejects} end")
    return f"case when {n} = 0 then 0::bigint when {part} >= {whole} then {n} else {_let(drawn, 'k', f'case when 2*{part} > {whole} then {n} - k else k end')} end"


def _multinomial(n: str, places: str, whole: str, text) -> str:
    got = _binomial("m.remains", "place.w", "m.among", lambda j: text("place", j))
    step = _let(got, "taken", "{'remains': m.remains - taken, 'among': m.among - place.w, 'drawn': list_append(m.drawn, taken)}")
    return f"list_reduce({places}, lambda m, place: {step}, {{'remains': {n}, 'among': {whole}, 'drawn': []::bigint[]}}).drawn"


_KEY = "'{seed}|' || data || '|' || spp || '|' || run".format(seed=SEED)


def _scrambled(x: str) -> str:
    (p, q), (f, g) = permute.PRIMES, permute.FACTORS
    y = f"(({x} + 1) * {f} % {p})"
    return f"(({y} * {y} % {q} + {y}) * {g} % {p})"


def _rounds() -> str:
    """The first pass of a permutation, one nested selection a round."""
    sql = "select *, number // b as high, number % b as low from v_stations_in_runs"
    for k in range(permute.ROUNDS):
        change = f"(low + {_scrambled(f'k{k} + high')}) % b as low" if k % 2 else f"(high + {_scrambled(f'k{k} + low')}) % a as high"
        sql = f"select * replace ({change}) from ({sql})"
    return sql


def _walk() -> str:
    """A number put through the permutation again until it is below n."""
    keys = ", ".join(f"{{'k': {k}, 'key': k{k}}}" for k in range(permute.ROUNDS))
    once = f"""list_reduce([{keys}], lambda d, r: case when r.k % 2 = 0 then {{'high': (d.high + {_scrambled("r.key + d.low")}) % a, 'low': d.low}}
        else {{'high': d.high, 'low': (d.low + {_scrambled("r.key + d.high")}) % b}} end, {{'high': s // b, 'low': s % b}})"""
    return f"list_reduce(range(0, a*b - n + 1), lambda s, i: case when s < n then s else {_let(once, 'd', 'd.high*b + d.low')} end, x)"


VIEWS = {
    "v_station": """
        select o_orderkey, o_custkey::varchar || '_' || o_orderkey::varchar as cruise_station, o_orderstatus as data,
               case when o_orderkey % 97 = 0 then null else o_totalprice/2e4 - 1e0 end as sst, o_orderdate as dt
        from orders""",
    "v_occurrence": """
        select p.p_type as spp, s.cruise_station, s.sst, s.data, sum(l.l_quantity) as abd
        from lineitem l join part p on l.l_partkey = p.p_partkey join v_station s on l.l_orderkey = s.o_orderkey
        group by p.p_type, s.cruise_station, s.sst, s.data""",
    "v_wide": """
        select cruise_station, data, coalesce(sst, 9999e0) as sst,
               sum(case when spp = 'ECONOMY' then abd end) as economy_10m2,
               sum(case when spp = 'PROMO' then abd end) as promo_10m2,
               sum(case when spp = 'STANDARD' then abd end) as standard_10m2,
               sum(case when spp = 'SMALL' then abd end) as small_10m2,
               sum(case when spp = 'MEDIUM' then abd end) as medium_10m2,
               sum(case when spp = 'LARGE' then abd end) as large_10m2
        from v_occurrence group by cruise_station, data, sst""",
    "v_coded": """
        select s.cruise_station, 170511100 + l.l_partkey % 5 as taxa_code,
               case when l.l_orderkey % 50 = 0 and l.l_linenumber = 1 then null else l.l_quantity end as abundance
        from lineitem l join v_station s on l.l_orderkey = s.o_orderkey""",
    "v_eggs": """
        select s.cruise_station, case when l.l_partkey % 101 = 0 then null else p.p_type end as common_name,
               l.l_quantity/5e1 as diameter
        from lineitem l join part p on l.l_partkey = p.p_partkey join v_station s on l.l_orderkey = s.o_orderkey""",
    "v_sizes": """
        select o_custkey::varchar || '_' || o_orderkey::varchar as cruise_station, b.bin_idx,
               b.bin_idx/2e1 as bin, (o_orderkey*7 + b.bin_idx*3) % 4 as unid_frequency,
               (o_orderkey + b.bin_idx) % 3 as id_frequency
        from orders cross join (select range as bin_idx from range(1, 21)) b
        where o_orderpriority < '3'""",
    "v_counts": """
        select s.cruise_station, s.sst,
               case when s.o_orderkey % 29 = 0 then null else coalesce(e.n, 0) + s.o_orderkey % 4 end as egg_count,
               case when s.o_orderkey % 13 = 0 then null else 5e-1 + (s.o_orderkey % 10)/1e1 end as ihf
        from v_station s
        left join (select cruise_station, count(*) as n from v_eggs group by cruise_station) e
          on s.cruise_station = e.cruise_station""",
    "v_casts": """
        select s.cruise_station,
               floor(o.o_totalprice/3125e-1)/64e0 - 1e0 + floor(l.l_linenumber/2e0)/8e0 as sst
        from lineitem l join orders o on l.l_orderkey = o.o_orderkey join v_station s on s.o_orderkey = o.o_orderkey""",
    "v_cruise": """
        select o_orderkey as k, o_custkey,
               case o_orderkey % 5 when 0 then '2102' when 1 then '2105' when 2 then '2107' when 3 then '2109'
                    else '2103' end as cruise_id,
               o_custkey::varchar as station_id
        from orders""",
    "v_visits": """
        select case when k % 100 = 7 then null
                    else 'E' || (k % 100)::varchar || case when k % 2 = 1 then 'B' else '' end end as haul_id,
               cruise_id, station_id,
               38e0 + (o_custkey % 200)/64e0 + (k % 8)/512e0 as latitude,
               71e0 + (o_custkey % 220)/64e0 + (k % 4)/512e0 as longitude
        from v_cruise""",
    "v_waypoints": """
        select case when c_mktsegment = 'MACHINERY' then 'C' || c_custkey::varchar else c_custkey::varchar end as waypoint,
               3825e-2 + (c_custkey*13 % 325)/1e2 as latitude, -745e-1 + (c_custkey*7 % 350)/1e2 as longitude
        from customer""",
    "v_numbered": """
        select waypoint as station_id, latitude, longitude from v_waypoints
        where waypoint[1] in ('1','2','3','4','5','6','7','8','9')""",
    "v_grid": """
        select -745e-1 + (p_partkey % 211)/6e1 as lon, 3825e-2 + (p_partkey*3 % 196)/6e1 as lat,
               5e0 - (p_partkey*37 % 3100) as depth
        from part""",
    "v_barcodes": """
        select v.cruise_id, v.station_id,
               case l.l_returnflag when 'A' then 'Egg' when 'N' then 'Larva' else 'Juvenile' end as stage,
               case when l.l_partkey % 17 = 0 then '' else p.p_type end as common_name
        from lineitem l join part p on l.l_partkey = p.p_partkey join v_cruise v on l.l_orderkey = v.k""",
    "v_tows": """
        select distinct cruise_id, station_id,
               case when o_custkey % 60 = 0 then 0e0 else 5e0 + o_custkey % 60 end as tow_depth
        from v_cruise""",
    "v_sites": """
        select v.cruise_id || '_' || v.station_id as cruise_station,
               max(case when v.k % 97 = 0 then null else o.o_totalprice/2e4 - 1e0 end) as sst
        from v_cruise v join orders o on o.o_orderkey = v.k
        group by v.cruise_id, v.station_id
        having max(case when v.k % 97 = 0 then null else o.o_totalprice end) is not null""",
    "v_points": """
        select o_orderstatus as data, o_custkey::varchar || '_' || o_orderkey::varchar as cruise_station,
               strftime(o_orderdate, '%-d-%b-%y') as date_text, -8e1 + (o_custkey % 900)/64e0 as lon,
               case when o_orderkey % 31 = 0 then null else 335e-1 + (o_custkey % 800)/64e0 end as lat
        from orders""",
    "v_dated": """
        select row_number() over (partition by data order by md5(cruise_station), cruise_station) as i,
               data, cruise_station, strptime(date_text, '%d-%b-%y')::date as date, lon, lat
        from v_points""",
    "v_taxon_sums": """
        select cruise_station, pep_sp, pep_par, coalesce(pep_tri, 0) as pep_tri,
               coalesce(pep_tri, 0) + pep_sp + pep_par as pep_all
        from (select cruise_station,
                case when count(*) filter (where taxa_code = 170511100 and abundance is null) > 0 then null
                     else coalesce(sum(abundance) filter (where taxa_code = 170511100), 0) end as pep_sp,
                case when count(*) filter (where taxa_code = 170511101 and abundance is null) > 0 then null
                     else coalesce(sum(abundance) filter (where taxa_code = 170511101), 0) end as pep_par,
                case when count(*) filter (where taxa_code >= 170511102 and abundance is null) > 0 then null
                     else coalesce(sum(abundance) filter (where taxa_code >= 170511102), 0) end as pep_tri
              from v_coded group by cruise_station)""",
    "v_tally": """
        select cruise_station, common_name, ceil(diameter*20)::bigint as bin_idx, count(*) as n
        from v_eggs group by 1, 2, 3""",
    "v_binsizes": """
        select cruise_station, bin_idx, unid_frequency + id_frequency as tot from v_sizes""",
    "v_detection": """
        select t.cruise_station, t.barcoded_count, c.egg_count, c.egg_count - t.barcoded_count as diff,
               coalesce(c.egg_count - t.barcoded_count > 0, false) as subsampled
        from (select cruise_station, count(*) as barcoded_count from v_eggs group by cruise_station) t
        left join (select * from v_counts where egg_count is not null and ihf is not null and sst is not null) c
          on t.cruise_station = c.cruise_station
        where t.cruise_station in (select cruise_station from v_counts where sst is not null)""",
    "v_sub_bins": """
        select b.cruise_station, b.bin_idx, b.tot, t.common_name, t.n, t.n is not null as good,
               sum(t.n) over (partition by b.cruise_station, b.bin_idx) as tot_barcoded
        from v_binsizes b left join v_tally t on b.cruise_station = t.cruise_station and b.bin_idx = t.bin_idx
        where b.cruise_station in (select cruise_station from v_detection where subsampled)""",
    "v_by_size": """
        select cruise_station, common_name, sum(n * (tot + coalesce(moved, 0))::double / tot_barcoded) as tot
        from (select g.*, m.moved from v_sub_bins g
              left join (select cruise_station, near_bin, sum(tot) as moved
                         from (select b.cruise_station, b.bin_idx, b.tot, g.bin_idx as near_bin,
                                      row_number() over (partition by b.cruise_station, b.bin_idx
                                        order by abs(g.bin_idx - b.bin_idx), g.common_name nulls last, g.bin_idx) as rn
                               from v_sub_bins b join v_sub_bins g on b.cruise_station = g.cruise_station
                               where not b.good and b.tot > 0 and g.good) where rn = 1 group by 1, 2) m
                on g.cruise_station = m.cruise_station and g.bin_idx = m.near_bin
              where g.good)
        where common_name is not null group by 1, 2""",
    "v_by_share": """
        select e.cruise_station, e.common_name, count(*) / d.barcoded_count * d.egg_count as tot
        from v_eggs e join v_detection d on e.cruise_station = d.cruise_station
        where d.subsampled and e.cruise_station not in (select cruise_station from v_sizes)
        group by e.cruise_station, e.common_name, d.barcoded_count, d.egg_count""",
    "v_combined": """
        select x.common_name, x.cruise_station, case when x.tot = 0 then 1 else x.tot end as tot, c.sst, c.ihf,
               case when x.tot = 0 then 1 else x.tot end * c.ihf as est
        from (select common_name, cruise_station, count(*)::double as tot from v_eggs
              where cruise_station not in (select cruise_station from v_detection where subsampled) group by 1, 2
              union all select common_name, cruise_station, tot from v_by_size
              union all select common_name, cruise_station, tot from v_by_share) x
        join v_counts c on x.cruise_station = c.cruise_station
        where x.common_name is not null and c.sst is not null and c.ihf is not null""",
    "v_egg_stage": f"""
        select b.cruise_id || '_' || b.station_id as cruise_station, b.common_name, count(*) as n, any_value(s.sst) as sst
        from v_barcodes b left join v_sites s on s.cruise_station = b.cruise_id || '_' || b.station_id
        where b.cruise_id <> '2103' and b.stage = 'Egg' and b.common_name in {SPECIES}
        group by b.cruise_id, b.station_id, b.common_name""",
    "v_long": " union all ".join(
        f"select cruise_station, data, sst, '{t}' as spp, coalesce({t}, 0) as abd from v_wide where sst <> 9999" for t in TAXA),
    "v_effort": """
        select data, idx as bin_idx, count(*) as n, count(*) / sum(count(*)) over (partition by data) as prop_samples
        from (select data, round_even(sst*2, 0)::bigint as idx from v_station) where idx is not null
        group by data, idx""",
    "v_curve": f"""
        select data, spp, bin_idx/2e0 as temp_bin, prop_samples, prop_fish, q,
               q / nullif(sum(q) over w, 0) as q_norm, sum(q) over (w order by bin_idx) / nullif(sum(q) over w, 0) as cdf_q_norm
        from (select e.data, s.spp, e.bin_idx, e.prop_samples, coalesce(f.abd / t.abd, 0) as prop_fish,
                     coalesce(f.abd / t.abd, 0) / e.prop_samples as q
              from v_effort e cross join (select unnest([{SPECIES[1:-1]}]) as spp) s
              left join (select data, spp, round_even(sst*2, 0)::bigint as bin_idx, sum(abd) as abd
                         from v_occurrence group by 1, 2, 3) f
                on f.data = e.data and f.spp = s.spp and f.bin_idx = e.bin_idx
              left join (select data, spp, sum(abd) as abd from v_occurrence group by 1, 2) t
                on t.data = e.data and t.spp = s.spp)
        window w as (partition by data, spp)""",
    "v_crossing": """
        select data, spp, quant, temp_bin
        from (select *, rank() over (partition by data, spp, quant order by round(abs(cdf_q_norm - quant), 9)) as rk
              from v_curve cross join (select unnest([5e-2, 95e-2]) as quant) where cdf_q_norm is not null)
        where rk = 1""",
    "v_panel": f"""
        select s.data, s.cruise_station, s.sst, x.spp, coalesce(o.abd, 0) as abd
        from v_station s cross join (select unnest([{SPECIES[1:-1]}]) as spp) x
        left join v_occurrence o on o.data = s.data and o.cruise_station = s.cruise_station and o.spp = x.spp
        where s.sst is not null""",
    "v_value": """
        select data, spp, round_even(sst*2, 0)::bigint as bin_idx, abd, count(*) as w from v_panel group by all""",
    "v_block": """
        select data, spp, bin_idx, case when abd = 0 then -1 else 0 end as block, sum(w)::bigint as w from v_value group by all""",
    "v_bin": """
        select data, spp, bin_idx, list({'block': block, 'w': w} order by block) as blocks, sum(w)::bigint as w from v_block group by all""",
    "v_group": """
        select data, spp, list({'bin_idx': bin_idx, 'w': w} order by bin_idx) as bins, sum(w)::bigint as size from v_bin group by all""",
    "v_in_bins": f"""
        select data, spp, run, unnest(list_transform(bins, lambda x: x.bin_idx)) as bin_idx,
               unnest({_multinomial("size", "bins", "size", lambda p, j: f"md5({_KEY} || '|' || {p}.bin_idx || '|' || {j})")}) as n
        from v_group cross join (select range as run from range(1, {RUNS + 1}))""",
    "v_in_blocks": f"""
        select data, spp, run, bin_idx, unnest(list_transform(blocks, lambda x: x.block)) as block,
               unnest({_multinomial("n", "blocks", "w", lambda p, j: f"md5({_KEY} || '|' || bin_idx || '|' || {p}.block || '|' || {j})")}) as n
        from v_in_bins join v_bin using (data, spp, bin_idx)""",
    "v_rung": """
        select data, spp, bin_idx, abd, sum(w) over (partition by data, spp, bin_idx order by abd) - w as first
        from v_value where abd <> 0""",
    "v_picked": f"""
        select data, spp, run, bin_idx, ('0x' || substr(md5({_KEY} || '|' || bin_idx || '|0|draw|' || i // 2), 1 + 16 * (i % 2), 15))::bigint % w as at
        from (select b.*, v_block.w, unnest(range(0, n)) as i from v_in_blocks b join v_block using (data, spp, bin_idx, block) where block = 0)""",
    "v_draws": """
        select data, spp, run, bin_idx, 0e0 as abd, n from v_in_blocks where block = -1 and n > 0
        union all
        select p.data, p.spp, p.run, p.bin_idx, r.abd, count(*) as n from v_picked p asof join v_rung r
            on r.data = p.data and r.spp = p.spp and r.bin_idx = p.bin_idx and p.at >= r.first group by all""",
    "v_replicates": """
        select data, spp, run, bin_idx/2e0 as temp_bin,
               (sum(n*abd) / nullif(sum(sum(n*abd)) over w, 0)) / (sum(n) / sum(sum(n)) over w) as q
        from v_draws group by data, spp, run, bin_idx window w as (partition by data, spp, run)""",
    "v_edges": """
        select data, bin_idx, lead(bin_idx) over (partition by data order by bin_idx) as next_idx from v_effort""",
    "v_placed": """
        select s.data, s.cruise_station, e.bin_idx as edge
        from v_station s left join v_edges e
          on e.data = s.data and s.sst > e.bin_idx/2e0 and s.sst <= e.next_idx/2e0
        where s.sst is not null""",
    "v_seats": """
        select data, edge, row_number() over (partition by data order by edge nulls first) - 1 as seat,
               count(*) over (partition by data) as n_all
        from v_placed""",
    "v_stations_in_runs": f"""
        select t.*, k.* exclude (data) from (
            select data, cruise_station, row_number() over (partition by data order by md5(cruise_station), cruise_station) - 1 as number
            from v_station where sst is not null) t
        join (select *, ceil(n/a)::bigint as b from (
            select data, run, n, ceil(sqrt(n))::bigint as a, {", ".join(f"{_scrambled(_scrambled(f'base + run * 64 + {k}') + ' + run')} as k{k}" for k in range(permute.ROUNDS))}
            from (select data, count(*) as n, ('0x' || substr(md5('{SEED}|' || data), 1, 15))::bigint % {permute.PRIMES[0]} as base
                  from v_station where sst is not null group by data) cross join (select range as run from range(1, {PERMUTATIONS + 1})))) k
          on k.data = t.data""",
    "v_permuted": f"""
        select data, run, cruise_station, case when x < n then x else {_walk()} end as seat
        from (select *, high*b + low as x from ({_rounds()}))""",
    "v_null_q": f"""
        select g.data, g.spp, g.run, g.bin_idx,
               coalesce(f.abd, 0) / nullif(t.abd, 0) / nullif(coalesce(n.n, 0) / a.n_all, 0) as q
        from (select * from v_effort cross join (select distinct spp from v_panel) cross join (select range as run from range(1, {PERMUTATIONS + 1}))) g
        join (select data, any_value(n_all) as n_all from v_seats group by 1) a on a.data = g.data
        left join (select data, edge, count(*) as n from v_seats group by 1, 2) n on n.data = g.data and n.edge = g.bin_idx
        left join (select data, spp, sum(abd) as abd from v_panel group by 1, 2) t on t.data = g.data and t.spp = g.spp
        left join (select p.data, o.spp, p.run, s.edge, sum(o.abd) as abd
                   from v_permuted p join v_panel o on o.data = p.data and o.cruise_station = p.cruise_station and o.abd <> 0
                   join v_seats s on s.data = p.data and s.seat = p.seat group by 1, 2, 3, 4) f
          on f.data = g.data and f.spp = g.spp and f.run = g.run and f.edge = g.bin_idx""",
    "v_fit_rows": """
        select spp, case when data = 'F' then 'Larvae' else 'Eggs' end as stage, temp_bin as x,
               round(cdf_q_norm, 4) as y
        from v_curve where cdf_q_norm is not null""",
}


def _newton_views() -> dict[str, str]:
    """Weighted least squares repeated a fixed number of times, one view per step."""
    solve = """select spp, stage, (c*d - b*e)/(a*c - b*b) as b0, (a*e - b*d)/(a*c - b*b) as b1, a, b, c
        from (select spp, stage, sum(w) as a, sum(w*x) as b, sum(w*x*x) as c, sum(wz) as d, sum(wz*x) as e
              from ({rows}) group by spp, stage)"""
    first = """select *, m*(1 - m) as w, m*(1 - m)*ln(m/(1 - m)) + y - m as wz
        from (select *, (y + 5e-1)/2 as m from v_fit_rows)"""
    later = """select *, m*(1 - m) as w, m*(1 - m)*eta + y - m as wz
        from (select *, 1/(1 + exp(-eta)) as m
              from (select r.*, s.b0 + s.b1*r.x as eta from v_fit_rows r join v_step{k} s using (spp, stage)))"""
    out = {"v_step0": solve.format(rows=first)}
    for k in range(NEWTON_STEPS):
        out[f"v_step{k + 1}"] = solve.format(rows=later.format(k=k))
    last, before = f"v_step{NEWTON_STEPS}", f"v_step{NEWTON_STEPS - 1}"
    out["v_fit"] = f"""
        select s.spp, s.stage, s.b0, s.b1, s.c/(s.a*s.c - s.b*s.b) as v00, -s.b/(s.a*s.c - s.b*s.b) as v01,
               s.a/(s.a*s.c - s.b*s.b) as v11, p.chi/(p.n - 2) as dispersion, p.n, p.low, p.high
        from {last} s
        join (select spp, stage, sum((y - m)*(y - m)/(m*(1 - m))) as chi, count(*) as n, min(x) as low, max(x) as high
              from (select r.*, 1/(1 + exp(-(b.b0 + b.b1*r.x))) as m from v_fit_rows r join {before} b using (spp, stage))
              group by spp, stage) p using (spp, stage)"""
    out["v_band"] = """
        select spp, stage, temp, prop, se, prop - 1959963984540054e-15*se as lower, prop + 1959963984540054e-15*se as upper
        from (select *, sqrt(dispersion*(v00 + 2*temp*v01 + temp*temp*v11))*prop*(1 - prop) as se
              from (select f.*, g.temp, 1/(1 + exp(-(f.b0 + f.b1*g.temp))) as prop
                    from v_fit f cross join (select range/2e0 as temp from range(-10, 120)) g))"""
    return out


VIEWS |= _newton_views()

COMMON_NAME = "case spp when 'economy_10m2' then 'Economy Fish' when 'ECONOMY' then 'Economy Fish' " \
    "when 'promo_10m2' then 'Promo Fish' when 'PROMO' then 'Promo Fish' " \
    "when 'standard_10m2' then 'Standard Fish' when 'STANDARD' then 'Standard Fish' else spp end"
OF_INTEREST = "select unnest(['Economy Fish', 'Promo Fish', 'Standard Fish']) as spp"


def _merged_views() -> dict[str, str]:
    """The merged surveys, their curve and panel, and the draws and fits above with these as input."""
    out = {
        "v_m_catch": f"""
            select {COMMON_NAME} as spp, cruise_station, sst, abd, data
            from (select common_name as spp, cruise_station, sst, est as abd, 'egg_counts' as data from v_combined
                  union all select common_name, cruise_station, sst, n, 'egg_barcodes' from v_egg_stage
                  union all select spp, cruise_station, sst, abd, 'larvae' from v_long)""",
        "v_m_eggs": """
            select cruise_station, sst, 'egg_counts' as data from v_counts where egg_count is not null and ihf is not null and sst is not null
            union all select cruise_station, sst, 'egg_barcodes' from v_sites""",
        "v_m_share": """
            select data, bin_idx, n / sum(n) over (partition by data) as prop_samples
            from (select data, round_even(sst*2, 0)::bigint as bin_idx, count(*) as n
                  from (select * from v_m_eggs union all select cruise_station, sst, 'larvae' from v_station) where sst is not null group by 1, 2)""",
        "v_m_curve": f"""
            select data, spp, bin_idx/2e0 as temp_bin, prop_samples, prop_fish, q, q / nullif(sum(q) over w, 0) as q_norm,
                   sum(q) over (w order by bin_idx) / nullif(sum(q) over w, 0) as cdf_q_norm
            from (select e.data, s.spp, e.bin_idx, e.prop_samples, coalesce(f.abd / t.abd, 0) as prop_fish,
                         coalesce(f.abd / t.abd, 0) / e.prop_samples as q
                  from v_m_share e cross join ({OF_INTEREST}) s
                  left join (select data, spp, round_even(sst*2, 0)::bigint as bin_idx, sum(abd) as abd from v_m_catch group by 1, 2, 3) f
                    on f.data = e.data and f.spp = s.spp and f.bin_idx = e.bin_idx
                  left join (select data, spp, sum(abd) as abd from v_m_catch group by 1, 2) t on t.data = e.data and t.spp = s.spp)
            window w as (partition by data, spp)""",
        "v_m_panel": f"""
            select s.data, s.cruise_station, s.sst, x.spp, coalesce(c.abd, 0)::double as abd
            from (select * from v_m_eggs union all select cruise_station, avg(distinct sst), 'larvae' from v_casts group by 1) s
            cross join ({OF_INTEREST}) x
            left join v_m_catch c on c.data = s.data and c.cruise_station = s.cruise_station and c.spp = x.spp
            where s.sst is not null""",
        "v_m_fit_rows": """
            select spp, case when data = 'larvae' then 'Larvae' else 'Eggs' end as stage, temp_bin as x, round(cdf_q_norm, 4) as y
            from v_m_curve where cdf_q_norm is not null""",
    }
    chain = ["value", "block", "bin", "group", "in_bins", "in_blocks", "rung", "picked", "draws", "replicates", "fit", "band"]
    chain += [f"step{k}" for k in range(NEWTON_STEPS + 1)]
    for name in chain:
        out[f"v_m_{name}"] = re.sub(rf"\bv_({'|'.join(chain)}|panel|fit_rows)\b", r"v_m_\1", VIEWS[f"v_{name}"])
    return out


VIEWS |= _merged_views()

BAND = "spp, stage, temp, round(prop, 4) as prop, round(se, 4) as se, round(lower, 4) as lower, round(upper, 4) as upper, " \
    "true as converged"


def _cases(branches: list[tuple[str, str]], rest: str) -> str:
    return "case " + " ".join(f"when {c} then {r}" for c, r in branches) + f" else {rest} end"


POISSON = " + ".join(f"(u >= {c!r}e0)::int" for c in poisson_cutoffs())
POISSON_SUMS = f"""
        select data, spp, run, bin_idx, sum(w)::bigint as n_samples, sum(w*abd) as n_fish
        from (select *, {POISSON} as w
              from (select data, spp, run, round_even(sst*2, 0)::bigint as bin_idx, abd,
                      ('0x' || substr(md5('{SEED}|' || data || '|' || spp || '|' || run || '|' || cruise_station), 1, 15))::bigint
                        / 1152921504606846976e0 as u
                    from v_panel cross join (select range as run from range(1, {POISSON_RUNS + 1}))))
        where w > 0 group by data, spp, run, bin_idx"""
SEASON_COLUMNS = "count(*) as total, " + ", ".join(
    f"count(*) filter (where cruise_id[4:] = '{c}') as {n}"
    for c, n in (("5", "spring"), ("2", "winter"), ("7", "summer"), ("9", "fall"))
) + ", count(*) filter (where cruise_id[4:] not in ('5','2','7','9')) as other"
NO_EXTRA_HAULS = "(haul_id not in ('E1B','E25B') or haul_id is null)"
DENSITY = "round(n / nullif(tow_depth, 0) * 9e-2 * pi(), 6) as density, " \
    "round(n / nullif(tow_depth * pi() * 9e-2, 0), 6) as density_by_volume"
SEASON = "case when {m} in (12,1,2) then 'Winter' when {m} in (3,4,5) then 'Spring' " \
    "when {m} in (6,7,8) then 'Summer' else 'Fall' end"
POINT = "data, cruise_station, date, month(date)::int as month, year(date)::int as year, day(date)::int as day, lon, lat, " \
    "4326 as srid, " + SEASON.format(m="month(date)") + " as season, data || '-' || i as point_id"

QUERIES = {
    "scan_survey_csv": "select cruise_station, data, sst from v_station",
    "scan_cast_report": """
        select 'haul' as "column", count(*) as rows, count(*) filter (where haul_id is null) as nulls,
               count(*) filter (where haul_id like '%B') as lost from v_visits
        union all select 'cruise_id', count(*), 0, 0 from v_visits union all select 'latitude', count(*), 0, 0 from v_visits""",
    "sink_bucketed_join": "select e.cruise_station, s.sst, count(*) as n from v_eggs e left join v_station s using (cruise_station) group by all",
    "exact_sum_by_group": """
        select l_returnflag, printf('%.6f', fsum(l_extendedprice / 3)) as x, printf('%.6f', fsum(l_discount - 5e-2)) as y from lineitem group by all""",
    "scan_sheet_set": "select c_mktsegment as sheet, (c_custkey % 20)/2e1 as bin, c_nationkey::double as unid_frequency, "
                      "c_acctbal as id_frequency from customer",
    "sink_roundtrip": "select data, bin_idx, n, round(prop_samples, 6) as prop_samples from v_effort",
    "drop_rowname_column": "select cruise_station, sst from v_station",
    "scan_depth_grid": "select * from v_grid where lon between -745e-1 and -71 and lat between 3825e-2 and 415e-1",
    "project_columns": "select sst, cruise_station, data, economy_10m2 from v_wide",
    "rename_columns": 'select cruise_station, common_name as "Common Name", diameter as "Egg Diameter (mm)" from v_eggs',
    "derive_columns": "select cruise_station, round_even(sst*2, 0)::bigint/2e0 as temp_bin, egg_count*ihf as est from v_counts",
    "filter_predicates": "select * from v_counts where sst >= 10 and egg_count > 3 or ihf = 5e-1 and not egg_count = 2",
    "filter_in_list": f"select * from v_occurrence where spp in {SPECIES}",
    "filter_not_in_list": f"select * from v_visits where {NO_EXTRA_HAULS}",
    "filter_not_null": "select * from v_counts where sst is not null",
    "drop_any_null": "select * from v_counts where sst is not null and egg_count is not null and ihf is not null",
    "sentinel_to_null": "select * replace (nullif(sst, 9999) as sst) from v_wide",
    "absence_to_zero": "select * replace (coalesce(economy_10m2, 0) as economy_10m2, coalesce(promo_10m2, 0) as promo_10m2) "
                       "from v_wide",
    "split_env_and_taxa": "select cruise_station, nullif(sst, 9999) as sst, "
                          + ", ".join(f"coalesce({t}, 0) as {t}" for t in TAXA) + " from v_wide",
    "fix_labels": "select cruise_station, case common_name when 'SMALL' then 'Small flounder' when 'LARGE' then "
                  "'Large flounder' else common_name end as common_name, diameter from v_eggs",
    "harmonise_taxa": "select " + _cases([("data='F' and spp='SMALL'", "'Silver Hake'"),
                                          ("data='O' and spp='SMALL'", "'Butterfish'"),
                                          ("data='P' and spp='LARGE'", "'Silver Hake'")], "spp")
                      + " as spp, cruise_station, sst, data, abd from v_occurrence",
    "harmonise_taxa_catchall": "select case spp when 'SMALL' then 'Fourspot Flounder' when 'LARGE' then 'Silver Hake' "
                               "else 'Gulfstream Flounder' end as spp, cruise_station, sst, data, abd from v_occurrence",
    "bbox_filter": "select * from v_grid where lon >= -74 and lon <= -72 and lat >= 39 and lat <= 405e-1",
    "floor_nonzero": "select cruise_station, case when egg_count - 3 = 0 then 1e0 else (egg_count - 3)::double end as tot "
                     "from v_counts",
    "left_join_station": "select e.*, c.sst, c.ihf from v_eggs e left join (select * from v_counts where ihf is not null) c "
                         "on e.cruise_station = c.cruise_station",
    "left_join_multi_key": "select b.*, t.tow_depth from (select cruise_id, station_id, count(*) as n from v_barcodes "
                           "group by 1, 2) b left join (select * from v_tows where tow_depth > 0) t "
                           "on b.cruise_id = t.cruise_id and b.station_id = t.station_id",
    "left_join_waypoint": "select v.station_id, v.n, w.latitude, w.longitude from (select station_id, count(*) as n "
                          "from v_visits group by 1) v left join v_numbered w on v.station_id = w.station_id",
    "right_join_size_bins": "select b.cruise_station, b.bin_idx, t.common_name, t.n, 1::bigint as copies, "
                            "b.tot::double as freq, case when b.tot > 0 then b.tot::double end as spare from v_tally t "
                            "right join v_binsizes b on t.cruise_station = b.cruise_station and t.bin_idx = b.bin_idx",
    "semi_join_stations": "select o_orderkey, cruise_station, data, sst from v_station s where "
                          "exists (select 1 from v_sizes z where z.cruise_station = s.cruise_station and z.id_frequency > 1) "
                          "or exists (select 1 from v_counts c where c.cruise_station = s.cruise_station and c.egg_count > 5)",
    "anti_join_stations": "select * from v_eggs e where not exists (select 1 from v_sizes z "
                          "where z.cruise_station = e.cruise_station)",
    "unmatched_audit": "select cruise_station from v_station except select cruise_station from v_eggs",
    "nearest_bin_join": """
        select cruise_station, bin_idx, near_bin as nearest_bin_idx, tot::double as moved_frequency
        from (select b.cruise_station, b.bin_idx, b.tot, g.bin_idx as near_bin,
                     row_number() over (partition by b.cruise_station, b.bin_idx
                       order by abs(g.bin_idx - b.bin_idx), g.common_name nulls last, g.bin_idx) as rn
              from v_binsizes b
              join (select t.* from v_tally t join v_binsizes z
                      on z.cruise_station = t.cruise_station and z.bin_idx = t.bin_idx) g
                on g.cruise_station = b.cruise_station
              where b.tot > 0 and not exists (select 1 from v_tally t
                where t.cruise_station = b.cruise_station and t.bin_idx = b.bin_idx))
        where rn = 1""",
    "zero_filled_panel": "select data, cruise_station, sst, spp, abd from v_panel",
    "dimension_grid": f"select d.data, s.spp from (select distinct data from v_station) d "
                      f"cross join (select unnest([{SPECIES[1:-1]}]) as spp) s",
    "curve_ci_report": """
        select coalesce(c.data, i.data) as data, coalesce(c.spp, i.spp) as spp, coalesce(c.temp_bin, i.temp_bin) as temp_bin,
               round(c.q, 6) as q, round(i.lower_ci, 6) as lower_ci, round(i.upper_ci, 6) as upper_ci
        from v_curve c full join (select data, spp, temp_bin, quantile_cont(q, 5e-2) as lower_ci,
                                         quantile_cont(q, 95e-2) as upper_ci from v_replicates group by 1, 2, 3) i
          on c.data = i.data and c.spp = i.spp and c.temp_bin = i.temp_bin""",
    "tally_groups": "select cruise_id, stage, station_id, common_name, count(*) as n from v_barcodes group by all",
    "sum_by_group": "select data, spp, sum(abd) as total from v_occurrence group by all",
    "conditional_sums": "select * from v_taxon_sums",
    "share_of_total": "select sum(pep_tri)/(sum(pep_tri) + sum(pep_par)) as share_tri from v_taxon_sums",
    "mean_by_station": "select cruise_station, avg(sst) as sst from v_casts group by 1",
    "mean_of_distinct": "select cruise_station, avg(distinct sst) as sst from v_casts group by 1",
    "distinct_species_count": "select cruise_id, stage, count(distinct common_name) as count_sp from v_barcodes group by all",
    "distinct_species_sketched": "select cruise_id, stage, count(distinct common_name) as count_sp from v_barcodes group by all",
    "distinct_sites_sketched": "select stage, count(distinct station_id) as n_sites, true as within_error from v_barcodes group by all",
    "distinct_rows": "select distinct * from v_barcodes",
    "quantile_by_group": "select l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 5e-2), 6) as p05, "
                         "round(quantile_cont(l_extendedprice, 5e-1), 6) as p50, "
                         "round(quantile_cont(l_extendedprice, 95e-2), 6) as p95 from lineitem group by all",
    "range_by_group": "select data, spp, min(sst) as lower, max(sst) as upper, max(sst) - min(sst) as range "
                      "from v_occurrence group by all",
    "effort_proportions": "select data, bin_idx, n, round(prop_samples, 6) as prop_samples from v_effort",
    "binned_histogram": "select data, ceil((sst - 25e-2)*2)::bigint/2e0 as sst_bin, count(*) as n from v_station "
                        "where sst >= -5e-1 and sst <= 22 group by 1, 2",
    "distinct_values": "select distinct cruise_id from v_visits",
    "total_over_partition": "select station_id, cruise_id, count(*) as n, sum(count(*)) over (partition by station_id)::bigint "
                            "as total from v_visits group by station_id, cruise_id",
    "normalise_over_partition": "select data, spp, temp_bin, round(q_norm, 6) as q_norm from v_curve",
    "running_cdf": "select data, spp, temp_bin, round(cdf_q_norm, 6) as cdf_q_norm from v_curve",
    "argmin_all_ties": "select data, spp, cruise_station, temp_bin from (select *, rank() over (partition by data, spp "
                       "order by abs(temp_bin - 12)) as rk from (select *, round_even(sst*2, 0)::bigint/2e0 as temp_bin "
                       "from v_occurrence where sst is not null)) where rk = 1",
    "argmin_first": "select data, spp, abs(sst - 12) as distance, cruise_station from (select *, row_number() over (partition "
                    "by data, spp order by abs(sst - 12), cruise_station) as rn from v_occurrence where sst is not null) "
                    "where rn = 1",
    "point_ids": "select data || '-' || i as point_id, cruise_station from v_dated",
    "ordered_bins": "select data, bin_idx, n from v_effort order by data, bin_idx",
    "seeded_shuffle": f"""
        with p as (select s.data, c.cruise_station, c.egg_count,
                     row_number() over (partition by s.data order by md5(c.cruise_station), c.cruise_station) as i,
                     row_number() over (partition by s.data order by md5('{SEED}|' || c.cruise_station), c.cruise_station) as r
                   from v_counts c join v_station s on s.cruise_station = c.cruise_station)
        select a.data, a.cruise_station, a.egg_count, b.egg_count as shuffled
        from p a join p b on a.data = b.data and a.i = b.r""",
    "union_surveys": "select cruise_station, sst, 'wide' as data from v_wide "
                     "union all select cruise_station, sst, 'site' from v_sites",
    "taxa_to_long": " union all ".join(f"select cruise_station, sst, '{t}' as spp, {t} as abd from v_wide" for t in TAXA),
    "season_to_wide": f"select station_id, {SEASON_COLUMNS} from v_visits group by 1",
    "half_degree_bin": "select cruise_station, round_even(sst*2, 0)::bigint as bin_idx, "
                       "round_even(floor(sst*4)/4*2, 0)::bigint/2e0 as tie_bin from v_station",
    "ceil_size_bin": "select cruise_station, ceil(diameter*20)::bigint as bin_idx, ceil(diameter*20)/20 as bin from v_eggs",
    "round_digits": "select data, spp, temp_bin, round(cdf_q_norm, 4) as round_cdf from v_curve",
    "station_key": "select o_orderkey, o_orderpriority || '_' || case when o_orderkey % 97 = 0 then 'NA' "
                   "else o_custkey::varchar end as cruise_station from orders",
    "substring_codes": "select haul_id, station_id[1] as transect, cruise_id[4:] as season from v_visits",
    "lenient_cast": "select o_orderkey, case when o_orderkey % 7 = 0 then null else o_totalprice end as price from orders",
    "parse_day_mon_yy": "select cruise_station, strptime(date_text, '%d-%b-%y')::date as date from v_points",
    "date_parts": "select cruise_station, month(date)::int as month, year(date)::int as year, day(date)::int as day from v_dated",
    "season_of_month": "select o_orderkey, " + SEASON.format(m="m") + " as season from (select o_orderkey, "
                       "case when o_orderkey % 97 = 0 then null else month(o_orderdate) end as m from orders)",
    "depth_band": "select lon, lat, depth, case when depth >= -100 then case when depth < -15 then 'b' else 'a' end "
                  "else 'c' end as band, case when depth >= -15 then 'a' end as level from v_grid",
    "sea_mask": "select lon, lat, case when depth > 1 then null else depth end as depth from v_grid",
    "isobath_bucket": "select lon, lat, depth, ((depth <= 0)::int + (depth <= -50)::int + (depth <= -100)::int + "
                      "(depth <= -500)::int + (depth <= -1000)::int + (depth <= -2000)::int + (depth <= -3000)::int) as bucket "
                      "from v_grid",
    "density_per_tow": f"select b.cruise_id, b.station_id, b.n, {DENSITY} from (select cruise_id, station_id, count(*) as n "
                       "from v_barcodes group by 1, 2) b left join v_tows t "
                       "on t.cruise_id = b.cruise_id and t.station_id = b.station_id",
    "predictor_grid": """
        select data, unnest(range(round_even(min(sst)*2, 0)::bigint, round_even(max(sst)*2, 0)::bigint + 1))/2e0 as temp,
               'data' as kind from v_station group by data
        union all select data, range/2e0, 'fixed' from (select distinct data from v_station) cross join range(-1, 61)""",
    "sign_flip_lon": "select station_id, latitude, -longitude as longitude from v_visits",
    "niche_overlap_term": "select data, spp, temp_bin, round(sqrt(prop_samples*prop_fish), 6) as niche from v_curve",
    "normal_ci": "select o_custkey, round(fit - 1959963984540054e-15*se, 4) as lower, "
                 "round(fit + 1959963984540054e-15*se, 4) as upper from (select o_custkey, avg(o_totalprice) as fit, "
                 "stddev(o_totalprice)/sqrt(count(*)) as se from orders group by 1)",
    "point_columns": "select waypoint, longitude as lon, latitude as lat, 4326 as srid from v_waypoints",
    "taxon_split_abundance": "select s.cruise_station, s.data, s.sst, t.pep_sp, t.pep_par, t.pep_tri, t.pep_all "
                             "from v_station s left join v_taxon_sums t on s.cruise_station = t.cruise_station",
    "wide_survey_to_occurrence": "select cruise_station, data, sst, spp, abd from v_long",
    "station_temperature": "select cruise_station, avg(sst) as sst from v_casts "
                           "where cruise_station in (select cruise_station from v_sizes where id_frequency > 1) "
                           "or cruise_station in (select cruise_station from v_counts where egg_count > 5) group by 1",
    "subsample_detection": "select * from v_detection",
    "size_stratified_expansion": "select cruise_station, common_name, round(tot, 6) as tot from v_by_size",
    "proportional_expansion": "select cruise_station, common_name, round(tot, 6) as tot from v_by_share",
    "combined_expansion": "select common_name, cruise_station, round(tot, 6) as tot, sst, ihf, round(est, 6) as est "
                          "from v_combined",
    "egg_stage_occurrence": "select * from v_egg_stage",
    "merge_surveys": f"""
        select {COMMON_NAME} as spp, cruise_station, sst, round(abd, 6) as abd, data,
               round_even(sst*2, 0)::bigint/2e0 as temp_bin
        from (select common_name as spp, cruise_station, sst, est as abd, 'egg_counts' as data from v_combined
              union all select common_name, cruise_station, sst, n, 'egg_barcodes' from v_egg_stage
              union all select spp, cruise_station, sst, abd, 'larvae' from v_long)""",
    "merged_curve": """
        select data, spp, temp_bin, round(prop_samples, 5) as prop_samples, round(prop_fish, 5) as prop_fish, round(q, 5) as q,
               round(q_norm, 5) as q_norm, round(cdf_q_norm, 5) as cdf_q_norm from v_m_curve""",
    "merged_panel": "select data, cruise_station, sst, spp, round(abd, 6) as abd from v_m_panel",
    "merged_quotient_ci": "select data, spp, temp_bin, round(quantile_cont(q, 5e-2), 5) as lower_ci, "
                          "round(quantile_cont(q, 95e-2), 5) as upper_ci from v_m_replicates group by 1, 2, 3",
    "merged_stage_comparison": f"select {BAND} from v_m_band join (select spp, stage, low, high from v_m_fit) using (spp, stage) "
                               "where temp between low and high",
    "merge_surveys_effort": """
        select idx/2e0 as temp_bin, round(count(*)/sum(count(*)) over (partition by data), 6) as prop_samples, data
        from (select round_even(sst*2, 0)::bigint as idx, data
              from (select sst, 'egg_counts' as data from v_counts where egg_count is not null and ihf is not null
                    union all select sst, 'egg_barcodes' from v_sites union all select sst, 'larvae' from v_station))
        where idx is not null group by data, idx""",
    "spq_curve": "select data, spp, temp_bin, round(prop_samples, 6) as prop_samples, round(prop_fish, 6) as prop_fish, "
                 "round(q, 6) as q, round(q_norm, 6) as q_norm, round(cdf_q_norm, 6) as cdf_q_norm from v_curve "
                 "union all select data, 'ABSENT', bin_idx/2e0, round(prop_samples, 6), 0e0, 0e0, null, null from v_effort",
    "bootstrap_draws": "select * from v_draws",
    "bootstrap_poisson": POISSON_SUMS,
    "poisson_quotient_ci": f"""
        with p as ({POISSON_SUMS}),
        r as (select data, spp, bin_idx/2e0 as temp_bin,
                     (n_fish / nullif(sum(n_fish) over w, 0)) / (n_samples / sum(n_samples) over w) as q
              from p window w as (partition by data, spp, run))
        select data, spp, temp_bin, round(quantile_cont(q, 5e-2), 6) as lower_ci, round(quantile_cont(q, 95e-2), 6) as upper_ci
        from r group by 1, 2, 3""",
    "bootstrap_quotient": "select data, spp, run, temp_bin, round(q, 6) as q from v_replicates",
    "bootstrap_ci": "select data, spp, temp_bin, round(quantile_cont(q, 5e-2), 6) as lower_ci, "
                    "round(quantile_cont(q, 95e-2), 6) as upper_ci from v_replicates group by 1, 2, 3",
    "thermal_range_by_run": "select data, spp, run, min(temp_bin) as lower, max(temp_bin) as upper, "
                            "max(temp_bin) - min(temp_bin) as range from v_replicates where q >= 1 group by 1, 2, 3",
    "permutation_quotient_ci": """
        select data, spp, bin_idx/2e0 as temp_bin,
               case when bool_or(q is null) then null else round(quantile_cont(q, 5e-2), 6) end as lower_ci,
               case when bool_or(q is null) then null else round(quantile_cont(q, 95e-2), 6) end as upper_ci
        from v_null_q group by 1, 2, 3""",
    "logistic_cdf_fit": "select spp, stage, n, round(b0, 4) as b0, round(b1, 4) as b1, round(v00, 4) as v00, "
                        "round(v01, 4) as v01, round(v11, 4) as v11, round(dispersion, 4) as dispersion, low, high from v_fit",
    "logistic_cdf_predict": f"select {BAND} from v_band where temp between -5e-1 and 30",
    "stage_comparison": f"select {BAND} from v_band join (select spp, stage, low, high from v_fit) using (spp, stage) "
                        "where temp between low and high",
    "cdf_quantile_crossing": "select * from v_crossing",
    "niche_width": "select data, spp, max(temp) - min(temp) as width from (select data, spp, quant, avg(temp_bin) as temp "
                   "from v_crossing group by 1, 2, 3) group by 1, 2",
    "station_season_effort": f"select v.*, w.latitude, w.longitude from (select station_id, {SEASON_COLUMNS} from v_visits "
                             f"where {NO_EXTRA_HAULS} group by 1) v left join v_numbered w on w.station_id = v.station_id",
    "station_season_effort_from_visits": f"select station_id, {SEASON_COLUMNS}, avg(latitude) as latitude, "
                                         f"-avg(longitude) as longitude from v_visits where {NO_EXTRA_HAULS} group by 1",
    "station_species_tally": """
        select b.station_id, b.cruise_id, b.stage, b.common_name, b.n, w.latitude, w.longitude
        from (select cruise_id, stage, station_id, common_name, count(*) as n from v_barcodes
              where common_name <> '' and cruise_id <> '2103' and stage <> 'Juvenile' and common_name <> 'LARGE'
              group by all) b
        left join v_numbered w on w.station_id = b.station_id""",
    "cruise_egg_density": f"""
        select b.cruise_id, b.station_id, b.common_name, b.n, t.tow_depth, {DENSITY}
        from (select common_name, cruise_id, station_id, count(*) as n from v_barcodes
              where cruise_id = '2105' and stage = 'Egg' and common_name <> '' group by all) b
        left join v_tows t on t.cruise_id = b.cruise_id and t.station_id = b.station_id""",
    "survey_points_by_season": f"""
        select {POINT}, 'survey' as kind from v_dated
        union all select {POINT}, 'eggs' from v_dated where lat is not null and cruise_station in
          (select cruise_station from v_counts where egg_count is not null and ihf is not null and sst is not null)""",
}


def _with_views(sql: str) -> str:
    """The statement with the views it needs, in order of dependence."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_[a-z_0-9]+", text)):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ", ".join(f"{n} as ({VIEWS[n].strip()})" for n in needed)
    body = sql.strip()
    if body.startswith("with "):
        return f"with {views}, {body[5:]}"
    return f"with {views} {body}"


def statements() -> dict[str, str]:
    """SQL text per query name."""
    return {name: _with_views(sql) for name, sql in QUERIES.items()}
