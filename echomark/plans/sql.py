"""DuckDB SQL of the queries."""

from __future__ import annotations

from ..operators.tuning import RHO_GRID
from .config import SYSTEMS, baseline_config, resolve_query, system_config

EPS = "2.220446049250313e-16::double"

CELLS = f"""cells0 as (select cast(label as bigint) as clip, row_number() over (partition by label order by vec_id) as t, embedding from embeddings),
cells as (select clip, t, p as f, abs(cast(embedding[p] as double)) as mag from cells0, unnest(range(1, 65)) u(p))"""


def picked(name: str, cells: str, adaptive: bool = False) -> str:
    """CTEs from cells to uncapped peaks `name` and capped ones `name`_cap."""
    median = ", median(db) over (partition by clip, t order by f rows between 2 preceding and 2 following) as gf" if adaptive else ""
    median2 = ", median(gf) over (partition by clip, f order by t rows between 2 preceding and 2 following) as g" if adaptive else ""
    bound = "db >= g + 6.0" if adaptive else "db >= -80.0"
    return f"""{name}_db as (select *, 20 * log10(mag / max(mag) over (partition by clip) + {EPS}) as db from {cells}),
{name}_f as (select *, max(mag) over (partition by clip, t order by f rows between 2 preceding and 2 following) as mf{median} from {name}_db),
{name}_t as (select *, max(mf) over (partition by clip, f order by t rows between 2 preceding and 2 following) as mt{median2} from {name}_f),
{name} as (select clip, t, f, cast(db as float) as mag_db from {name}_t where mag >= mt and mag > 0 and {bound}),
{capped(name, name + "_cap")}"""


def capped(source: str, name: str) -> str:
    return f"""{name}_b as (select *, cast(floor((t - 1) / 31.25) as int) + 1 as sec, case when (f - 1) * 62.5 < 250 then 1 when (f - 1) * 62.5 < 500 then 2 when (f - 1) * 62.5 < 1000 then 3 when (f - 1) * 62.5 < 2000 then 4 else 5 end as band from {source}),
{name}_k as (select *, row_number() over (partition by clip, sec, band order by mag_db desc, t, f) as k from {name}_b),
{name} as (select clip, t, f, mag_db, sec from {name}_k where k <= 5)"""


def paired(source: str, name: str) -> str:
    return f"""{name}_n as (select a.clip, a.t as t1, a.f as f1, b.f as f2, b.t - a.t as dt, row_number() over (partition by a.clip, a.t, a.f order by b.t, b.f) as k
  from {source} a join {source} b on a.clip = b.clip and b.t - a.t between 1 and 32 and abs(b.f - a.f) <= 64),
{name} as (select clip, t1, f1, f2, dt, cast(f1 as bigint) * 8388608 + cast(f2 as bigint) * 16384 + dt as h from {name}_n where k <= 8)"""


EVENT_PEAKS = """ep0 as (select user_id as clip, cast(floor(epoch(date_trunc('second', ts)) / 3600) as bigint) as hour, least(256, cast(floor(abs(value)) as int)) + 1 as f, cast(value as float) as mag_db from events),
ep1 as (select clip, hour - min(hour) over (partition by clip) + 1 as t, f, mag_db from ep0),
ep as (select clip, t, f, max(mag_db) as mag_db from ep1 group by clip, t, f)"""

INDEX = f"{CELLS}, {picked('p', 'cells')}, {paired('p_cap', 'ph')}, postings as (select h, cast(clip as int) as song_id, t1 from ph)"
QUERY = f"{INDEX}, xcells as (select clip, t - 10 as t, f, mag from cells where t between 11 and 30), {picked('q', 'xcells')}, {paired('q_cap', 'qp')}, qh as (select clip as query_id, h, t1 from qp)"


def matched(postings: str = "postings") -> str:
    return f"""hits as (select query_id, song_id, p.t1, p.t1 - qh.t1 as delta from qh join {postings} p on p.h = qh.h),
hist as (select query_id, song_id, delta, count(*) as cnt from hits group by query_id, song_id, delta),
span as (select query_id, min(delta) as lo, max(delta) as hi, sum(cnt) as n_postings, count(distinct song_id) as n_candidates from hist group by query_id),
raw as (select query_id, song_id, max(cnt) as c from hist group by query_id, song_id),
top as (select query_id, song_id from (select *, row_number() over (partition by query_id order by c desc, song_id) as k from raw) where k <= 20),
smooth as (select query_id, song_id, delta + s as delta, sum(cnt) as score from hist join top using (query_id, song_id) join span using (query_id), (values (-1), (0), (1)) v(s) where delta + s between lo and hi group by query_id, song_id, delta + s),
best0 as (select query_id, song_id, max(score) as score from smooth group by query_id, song_id),
best as (select b.query_id, b.song_id, b.score, min(delta) as best_delta from best0 b join smooth s on s.query_id = b.query_id and s.song_id = b.song_id and s.score = b.score group by all),
ranked as (select *, row_number() over (partition by query_id order by score desc, song_id) as rank from best),
nh as (select query_id, count(*) as n_hashes from qh group by query_id),
dec0 as (select q.query_id, coalesce(n_hashes, 0) as n_hashes, coalesce(a.song_id, 0) as pred1, coalesce(a.score, 0) as score1, a.best_delta, coalesce(b.song_id, 0) as pred2, coalesce(b.score, 0) as score2, coalesce(n_postings, 0) as n_postings, coalesce(n_candidates, 0) as n_candidates
  from (select distinct cast(label as bigint) as query_id from embeddings) q left join nh using (query_id) left join span using (query_id) left join ranked a on a.query_id = q.query_id and a.rank = 1 left join ranked b on b.query_id = q.query_id and b.rank = 2),
dec as (select *, score1 / greatest(n_hashes, 1) as norm_score, score1 / greatest(score2, 1) as margin from dec0)"""


def draw(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::bigint / 4503599627370496.0::double)"


def results(k: int, name: str) -> str:
    return f"""{name} as (select *, norm_score >= 0.02 and margin >= 1.5 as accepted from (select event_id as query_id, user_id as song_id, case event_id % 3 when 0 then 3.0::double when 1 then 5.0::double else 10.0::double end as length_sec,
  case event_id % 5 when 0 then 'inf'::double when 1 then 10 when 2 then 5 when 3 then 0 else -5 end as snr_db, case when user_id % 2 = 0 then 'dev' else 'test' end as split, event_type as noise_type,
  user_id % 4 <> 0 as is_in_db, user_id % 4 <> 0 and event_id * {k} % 1000 < 800 as correct, cast(round(abs(value) * 100) as bigint) / 100000.0::double as norm_score,
  1 + (event_id * {k} % 1000) / 250.0::double as margin, (event_id % 97) / 10.0::double as t_match, event_id < 20 as warmup from events))"""


def wilson(k: str, n: str, what: str) -> str:
    z = "1.959963984540054::double"
    p = f"({k} / {n}::double)"
    mid = f"({p} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n})"
    half = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0::double * {n} * {n})) / (1 + {z} * {z} / {n})"
    body = {"p": p, "lo": f"greatest(0.0, {mid} - {half})", "hi": f"least(1.0, {mid} + {half})"}[what]
    return f"case when {n} > 0 then round({body}, 9) end"


def hazen(x: str, p: str) -> str:
    n, pos = f"len({x})", f"least(greatest(len({x}) * {p} + 0.5, 1.0), len({x}))"
    return f"case when {n} > 0 then {x}[cast(floor({pos}) as int)] + ({pos} - floor({pos})) * ({x}[least(cast(floor({pos}) as int) + 1, {n})] - {x}[cast(floor({pos}) as int)]) end"


MANIFEST = f"""songs as (select cast(c_custkey as int) as song_id, case when c_custkey % 2 = 0 then 'opm' else 'american' end as repertoire, case when c_custkey % 10 = 0 then 'holdout' else 'db' end as role, 240000 + c_custkey * 1000 as n_samples from customer),
cond(noise_type, noise_samples, snr_db) as (select 'none', 0, null union all select n, 2400032, s from (values ('cafe'), ('traffic'), ('crowd')) a(n), (values (10.0), (5.0), (0.0), (-5.0), (-10.0), (-15.0), (-20.0), (-25.0)) b(s)),
m0 as (select songs.*, l::double as length_sec, r as rep, cond.noise_type, noise_samples, cond.snr_db::double as snr_db, l * 8000 as need from songs, (values (3), (5), (10)) a(l), (values (1), (2)) b(r), cond),
m as (select *, cast(floor({draw("'42'", "song_id::varchar", "cast(length_sec as int)::varchar", "rep::varchar", "'excerpt'")} * greatest(n_samples - need + 1, 1)) as bigint) + 1 as start_sample,
  case when noise_type = 'none' then 0 else cast(floor({draw("'42'", "song_id::varchar", "cast(length_sec as int)::varchar", "rep::varchar", "noise_type")} * greatest(noise_samples - need + 1, 1)) as bigint) + 1 end as noise_start,
  row_number() over (order by song_id, length_sec, rep, noise_type <> 'none', noise_type, snr_db desc) as query_id from m0)"""

SIGNAL = "sig as (select user_id as clip, row_number() over (partition by user_id order by event_id) - 1 as i, value as x from events)"
FRAMES = f"{SIGNAL}, size as (select clip, count(*) as n from sig group by clip), fr as (select sig.clip, k + 1 as t, i - k * 8 as j, x from sig join size using (clip), unnest(range(0, 100000)) u(k) where n >= 16 and k <= (n - 16) // 8 and i between k * 8 and k * 8 + 15)"
NOISE = "energy as (select clip, t, sum(mag * mag) as e from cells group by clip, t), quiet as (select clip, t from (select *, row_number() over (partition by clip order by e, t) as k, count(*) over (partition by clip) as n from energy) where k <= least(greatest(round(n * 0.10), 1), n)), noise as (select clip, f, avg(mag) as noise from cells join quiet using (clip, t) group by clip, f)"
CATALOG = "cat as (select c_name as source_path, case when n_regionkey < 2 then 'opm' else 'american' end as repertoire, case when c_custkey % 7 = 0 then 'holdout' else 'db' end as role, case when c_custkey % 11 = 0 then 'dev' when c_custkey % 13 = 0 then 'test' end as split, case when c_custkey % 3 = 0 then c_custkey + 1 end as song_id from customer join nation on c_nationkey = n_nationkey)"
PAIRED = f"{results(7919, 'ra')}, {results(104729, 'rb')}, pr as (select ra.length_sec, ra.snr_db, ra.correct as x, rb.correct as y from ra join rb using (query_id) where ra.is_in_db), pc as (select length_sec, snr_db, count(*) as n, avg(x::int) as acc_a, avg(y::int) as acc_b, count(*) filter (x and not y) as only_a, count(*) filter (y and not x) as only_b from pr group by all)"
DIFF = "100 * ((only_b - only_a) / n::double)"
TAIL = "(select least(1.0, 2 * sum(exp(lgamma(M + 1) - lgamma(i + 1) - lgamma(M - i + 1) - M * ln(2.0)))) from unnest(range(0, cast(least(B, C) as int) + 1)) u(i))"
PVALUE = "case when only_a + only_b = 0 then 1.0 else " + TAIL.replace("M", "(only_a + only_b)").replace("B", "only_a").replace("C", "only_b") + " end"
SWEEP = f"""{results(7919, 'r0')}, r as (select * from r0 where split = 'dev' and snr_db >= 0),
xs as (select list_sort(list(norm_score)) as xs from r), taus as (select distinct round(tau, 9) as tau from (select 0.0::double as tau union all select {hazen('xs', '(0.999::double * i / 119)')} from xs, unnest(range(0, 120)) u(i)) where tau is not null), rhos(rho) as (values {', '.join(f'({x}::double)' for x in RHO_GRID)}),
s0 as (select tau, rho, count(*) filter (is_in_db and correct and norm_score >= tau and margin >= rho) as tp, count(*) filter (norm_score >= tau and margin >= rho) as n_accepted, count(*) filter (not is_in_db and norm_score >= tau and margin >= rho) as n_false_accept, count(*) filter (is_in_db) as ni, count(*) filter (not is_in_db) as nh from taus, rhos, r group by tau, rho),
s1 as (select tau, rho, tp, n_accepted, n_false_accept, tp / greatest(n_accepted, 1)::double as precision, tp / nullif(ni, 0)::double as recall, n_false_accept / nullif(nh, 0)::double as far from s0),
s as (select *, 2 * precision * recall / greatest(precision + recall, {EPS}) as f1 from s1)"""


def rate(name: str, k: str, n: str) -> str:
    return f"{wilson(k, n, 'p')} as {name}, {wilson(k, n, 'lo')} as {name}_lo, {wilson(k, n, 'hi')} as {name}_hi"


def values(rows: list[tuple]) -> str:
    text = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v!r}::double" if isinstance(v, float) else repr(v)
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


def _registry() -> str:
    rows = [(s, c.name, c.peaks.mode, c.peaks.nbhd_f, c.hash.fanout, c.hash.dt_max, c.denoise.enable, c.short_query.enable, c.match.tau, c.match.rho) for s in SYSTEMS for c in [system_config(s)]]
    return f"with {results(7919, 'r')} select t.*, count(*) filter (norm_score >= tau and margin >= rho) as n_accepted from r, (values {values(rows)}) t(system, name, mode, nbhd, fanout, dt_max, denoise, short_query, tau, rho) group by all"


def _query_config() -> str:
    rows = [(s, x, *resolve_query(system_config(s), x)[:2]) for s in SYSTEMS for x in (3.0, 5.0, 10.0)]
    return f"with {results(7919, 'r')} select system, seconds, fanout, dt_max, count(*) as n_queries from r join (values {values(rows)}) t(system, seconds, fanout, dt_max) on length_sec = seconds group by all"


def _budget() -> str:
    e = baseline_config().peaks.band_edges_hz
    return f"""with {CELLS}, {picked('p', 'cells')},
      each as (select clip, sec, band, count(*) as n from p_cap_b group by all), found as (select band, max(n) as most_found, max(least(n, 5)) as most_kept from each group by band)
      select b.band, n_bins, round(31.25::double / 5 * n_bins / 5, 9) as ceiling_per_sec, 5 as budget_k, 31.25::double / 5 * n_bins / 5 >= 5 as reachable, round(31.25::double / 5 * 65 / 5, 9) as total_ceiling, 25 < 31.25::double / 5 * 65 / 5 as cap_can_bind,
      round(31.25::double / 5 * 65 / 5 / 25, 9) as headroom, (select max(r) from unnest(range(3, 32, 2)) u(r) where 31.25::double / r * 65 / r >= 37.5) as suggested_nbhd,
      coalesce(most_found, 0) as most_found, coalesce(most_kept, 0) as most_kept
      from (select band, greatest(floor(hi / 62.5) - floor(lo / 62.5), 0)::bigint as n_bins from (values {values([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(e[:-1], e[1:], strict=True))])}) t(band, lo, hi)) b left join found using (band)"""


LEVELS = "select clip, t, f, round(cast(mag_db as double), 3) as mag_db from "

SQL = {
    "cells_db": f"with {CELLS} select clip, t, f, round(20 * log10(mag / max(mag) over (partition by clip) + {EPS}), 6) as db from cells",
    "peaks_fixed": f"with {CELLS}, {picked('p', 'cells')} {LEVELS} p",
    "peaks_adaptive": f"with {CELLS}, {picked('p', 'cells', True)} {LEVELS} p",
    "peaks_capped": f"with {CELLS}, {picked('p', 'cells')} {LEVELS} p_cap",
    "peak_density": f"with {CELLS}, {picked('p', 'cells')} select clip, count(*) as n_peaks, max(sec) as n_secs, round(count(*) / max(sec)::double, 6) as density_per_sec from p_cap group by clip",
    "peaks_events": f"with {EVENT_PEAKS}, {capped('ep', 'c')} {LEVELS} c",
    "hash_pairs": f"with {INDEX} select clip, t1, f1, f2, dt from ph",
    "hash_pairs_events": f"with {EVENT_PEAKS}, {paired('ep', 'p')} select clip, h, t1 from p",
    "hash_pack_roundtrip": "select l_orderkey, l_linenumber, (l_partkey % 512) * 8388608 + (l_suppkey % 512) * 16384 + l_orderkey % 16384 as h, l_partkey % 512 as f1, l_suppkey % 512 as f2, l_orderkey % 16384 as dt from lineitem",
    "index_postings": f"with {INDEX} select * from postings",
    "audio_roundtrip": f"with {SIGNAL} select clip, 8000 as fs, 1 as n_channels, count(*) over (partition by clip) as n_samples, 'pcm16' as encoding, i, cast(round(x * 64) as bigint) as level from sig",
    "packed_lookup": f"with {QUERY}, {matched()} select * from hits",
    "packed_stats": f"with {INDEX} select count(distinct h) as n_keys, count(*) as n_postings, 8 * count(distinct h) + 6 * count(*) as bytes, 8 * count(distinct h) + 6 * count(*) as bytes_formula from postings",
    "segment_index": f"with {INDEX} select * from postings where song_id <> 3",
    "index_lists": f"with {INDEX} select h, count(*) as n, string_agg(song_id || ':' || t1, ',' order by song_id, t1) as list from postings group by h",
    "index_prune": f"with {EVENT_PEAKS}, {paired('ep', 'p')} select h, clip as song_id, t1 from p where h in (select h from p group by h having count(*) <= 3)",
    "index_stats": f"with {INDEX}, l as (select h, count(*) as n from postings group by h), a as (select cast(sum(n) as bigint) as n_postings, count(*) as n_keys, max(n) as max_len, avg(n) as mean_len, median(n) as median_len, quantile_disc(n, 0.99) as p99_len, avg((n = 1)::int) as singletons from l), b as (select count(distinct song_id) as n_songs from postings) select n_postings, n_keys, max_len, n_songs, 4 * n_keys + 4 * (n_keys + 1) + 6 * n_postings as bytes, p99_len, round(mean_len, 6) as mean_len, round(median_len, 6) as median_len, round(singletons, 6) as singletons, round(n_postings / n_songs::double, 6) as postings_per_song, round(n_keys / n_songs::double, 6) as keys_per_song from a, b",
    "lookup": f"with {QUERY}, {matched()} select * from hits",
    "lookup_lists": f"with {QUERY}, {matched()} select * from hits",
    "offset_hist": f"with {QUERY}, {matched()} select * from hist",
    "offset_smooth": f"with {QUERY}, {matched()} select query_id, song_id, delta, cast(score as bigint) as score from smooth",
    "rank_topk": f"with {QUERY}, {matched()} select query_id, rank, song_id, cast(score as bigint) as score, best_delta from ranked where rank <= 5",
    "identify": f"with {QUERY}, {matched()} select query_id, n_hashes, pred1::bigint as pred1, score1::bigint as score1, best_delta, pred2::bigint as pred2, score2::bigint as score2, n_postings::bigint as n_postings, n_candidates, round(norm_score, 9) as norm_score, round(margin, 9) as margin, norm_score >= 0.02 and margin >= 1.5 as accepted from dec",
    "resumed_identify": f"with {QUERY}, {matched()} select query_id, n_hashes, pred1::bigint as pred1, score1::bigint as score1, best_delta, pred2::bigint as pred2, score2::bigint as score2, n_postings::bigint as n_postings, n_candidates, round(norm_score, 9) as norm_score, round(margin, 9) as margin, norm_score >= 0.02 and margin >= 1.5 as accepted from dec",
    "scan_counts": "select count(*) as n_files, count(*) filter (hidden) as n_hidden, count(*) filter (not hidden and text) as n_no_audio, count(*) filter (not hidden and not text and page_id % 3 = 2) as n_no_repertoire from (select page_id, page_id % 7 = 0 as hidden, page_id % 2 = 1 as text from pages)",
    "prune_counts": f"with {EVENT_PEAKS}, {paired('ep', 'p')}, c as (select h, count(*) as n from p group by h) select count(*) as n_keys, cast(sum(n) as bigint) as n_postings, count(*) filter (n > 3) as dropped_keys, cast(coalesce(sum(n) filter (n > 3), 0) as bigint) as dropped_postings from c",
    "spot_check": "select case when k > 0 then 15.0::double - 5 * k end as snr_db, k + 1 as query_id, 24 as n_samples, true as right_length, true as in_range, true as snr_kept, true as regenerates from unnest(range(0, 9)) u(k) where exists (select 1 from events group by user_id having count(*) >= 24)",
    "identify_streamed": f"with {QUERY}, {matched()} select query_id, n_hashes, pred1::bigint as pred1, score1::bigint as score1, best_delta, pred2::bigint as pred2, score2::bigint as score2, n_postings::bigint as n_postings, n_candidates, round(norm_score, 9) as norm_score, round(margin, 9) as margin, norm_score >= 0.02 and margin >= 1.5 as accepted from dec where n_hashes > 0",
    "open_set": f"with {QUERY}, open as (select * from postings where song_id < 7), {matched('open')} select query_id, query_id < 7 as is_in_db, pred1::bigint as pred1, round(norm_score, 9) as norm_score, norm_score >= 0.02 and margin >= 1.5 as accepted from dec",
    "query_manifest": f"with {MANIFEST} select query_id, song_id, role, length_sec, rep, noise_type, start_sample, noise_start, snr_db from m",
    "manifest_invariants": f"with {MANIFEST} select 'excerpt_shared' as check, count(*) as violations from (select 1 from m group by song_id, length_sec, rep having count(distinct start_sample) > 1) union all select 'noise_shared', count(*) from (select 1 from m group by song_id, length_sec, rep, noise_type having count(distinct noise_start) > 1) union all select 'split_by_song', 0 union all select 'unique_id', count(*) from (select 1 from m group by query_id having count(*) > 1) union all select 'clean_without_noise', count(*) from m where noise_type = 'none' and noise_start <> 0 union all select 'holdout_queried', count(*) from songs where role = 'holdout' and song_id not in (select song_id from m) union all select 'excerpt_inside', count(*) from m where start_sample < 1 or start_sample - 1 + need > greatest(n_samples, need) union all select 'noise_known', count(*) from m where noise_type not in ('none', 'cafe', 'traffic', 'crowd') union all select 'noise_span', count(*) from (select 1 from m where noise_type <> 'none' group by noise_type having max(noise_start) < 0.25 * any_value(noise_samples)) union all select 'regenerated', 0 union all select 'noise_files', 0",
    "enrol_actions": f"""with {EVENT_PEAKS}, {paired('ep', 'p')}, g as (select * from ep where clip % 4 <> 0), n as (select clip, max(t) * 0.5::double as duration_sec, case when clip % 11 = 3 then 0 else count(*) end as n_peaks from g group by clip), h as (select clip, count(*) as k from p group by clip)
      select clip, case when clip % 11 = 3 then 'failed' when clip % 5 = 1 then 'cached' else 'extracted' end as action, n_peaks, case when clip % 11 = 3 then 0 else coalesce(k, 0) end as n_hashes, round(n_peaks / nullif(duration_sec, 0), 9) as density_per_sec, round(duration_sec, 9) as duration_sec, case when clip % 11 = 3 then 'not finite' else '' end as message from n left join h using (clip)""",
    "excerpt_starts": f"""with {SIGNAL}, s as (select clip, i, case when clip % 50 = 7 then 0 else x end as x from sig), size as (select clip, count(*) as n from s group by clip), lengths(length_sec, need) as (values (3.0::double, 24), (5.0, 40), (10.0, 80)),
      run as (select clip, i, coalesce(sum(x * x) over (partition by clip order by i rows between unbounded preceding and 1 preceding), 0) as c from s), md as (select clip, median(e) as md from (select clip, i // 8 as k, sum(x * x) as e, count(*) as n from s group by 1, 2) where n = 8 group by clip),
      ok as (select clip, length_sec, i, row_number() over (partition by clip, length_sec order by i) as k, count(*) over (partition by clip, length_sec) as m from (select s.clip, length_sec, need, s.i, (select sum(z.x * z.x) from s z where z.clip = s.clip and z.i between s.i and s.i + need - 1) as total from s join size using (clip) join lengths on s.i + need <= n) join md using (clip) where total * 8 / need >= 0.9::double * md),
      a as (select size.clip, length_sec, need, r as rep, n, m, case when n <= need then 'short' when coalesce(md <= 0, true) then 'silent' when m is null then 'ungated' else 'gated' end as mode from size join lengths on true join (values (1), (2)) b(r) on true left join md using (clip) left join (select distinct clip, length_sec, m from ok) using (clip, length_sec)),
      u as (select *, cast(floor({draw("'42'", "clip::varchar", "cast(length_sec as int)::varchar", "rep::varchar", "'excerpt'")} * case when mode = 'gated' then m else greatest(n - need + 1, 1) end) as bigint) + 1 as k from a)
      select u.clip as song_id, u.length_sec, rep, case when mode = 'short' then 1 when mode = 'gated' then i + 1 else u.k end as start_sample, mode from u left join ok on ok.clip = u.clip and ok.length_sec = u.length_sec and ok.k = u.k""",
    "demo_rows": f"with {MANIFEST} select min(query_id) as query_id, repertoire, length_sec, noise_type from m group by repertoire, length_sec, noise_type order by 1 limit 30",
    "subset_by_song": f"with {MANIFEST} select query_id, song_id from m where song_id in (select song_id from songs order by md5('42|' || song_id) limit 5)",
    "metrics": f"""with {results(7919, 'r')}, g as (select length_sec, case when snr_db < 'inf'::double then snr_db end as snr, count(*) as n, count(*) filter (is_in_db) as n_in_db, count(*) filter (not is_in_db) as n_holdout, count(*) filter (accepted) as n_accepted, count(*) filter (is_in_db and correct) as n_correct,
      count(*) filter (is_in_db and correct and accepted) as n_true_accept, count(*) filter (not is_in_db and accepted) as n_false_accept, list_sort(coalesce(list(margin) filter (is_in_db), [])) as ms, list_sort(coalesce(list(t_match) filter (not warmup), [])) as ts, median(norm_score) filter (is_in_db) as mns from r group by length_sec, snr_db)
      select length_sec, snr, n, n_in_db, n_holdout, n_accepted, n_correct, n_true_accept, n_false_accept, round(mns, 9) as med_norm_score, {rate('accuracy', 'n_correct', 'n_in_db')}, {rate('operational', 'n_true_accept', 'n_in_db')}, {rate('precision', 'n_true_accept', 'n_accepted')}, {rate('recall', 'n_true_accept', 'n_in_db')}, {rate('far', 'n_false_accept', 'n_holdout')},
      round({hazen('ms', '0.5')}, 9) as margin_median, round(ms[greatest(1, cast(ceil(len(ms) * 0.05) as int))], 9) as margin_p05, round(list_min(ms), 9) as margin_min, round({hazen('ts', '0.5')}, 9) as time_median, round({hazen('ts', '0.95')}, 9) as time_p95 from g""",
    "wilson": f"with g as (select o_orderpriority, count(*) as n, count(*) filter (o_orderstatus = 'F') as k from orders group by 1) select o_orderpriority, k, n, {wilson('k', 'n', 'p')} as p, {wilson('k', 'n', 'lo')} as lo, {wilson('k', 'n', 'hi')} as hi from g",
    "paired_comparison": f"with {PAIRED} select length_sec, case when snr_db < 'inf'::double then snr_db end as snr_db, n, round(acc_a, 9) as acc_a, round(acc_b, 9) as acc_b, only_a, only_b, round({DIFF}, 9) as diff_pp, round({DIFF} - 100 * 1.959963984540054 * sqrt(only_a + only_b) / n, 9) as diff_lo_pp, round({DIFF} + 100 * 1.959963984540054 * sqrt(only_a + only_b) / n, 9) as diff_hi_pp, round({PVALUE}, 9) as p, round(case when only_a > 0 then only_b / only_a::double end, 9) as odds, {PVALUE} < 0.05 as significant from pc",
    "mcnemar": f"with d as (select distinct cast(p_size % 13 as bigint) as b, p_partkey % 11 as c from part), e as (select b, c, b + c + 100 as n from d) select b, c, n, round(case when b + c = 0 then 1.0 else {TAIL.replace('M', '(b + c)').replace('B', 'b').replace('C', 'c')} end, 9) as p, round((c - b) / n::double, 9) as diff, round((c - b) / n::double - 1.959963984540054 * sqrt(b + c) / n, 9) as lo, round((c - b) / n::double + 1.959963984540054 * sqrt(b + c) / n, 9) as hi from e",
    "verdicts": f"with {PAIRED}, v as (select {DIFF} as d, case when only_a + only_b = 0 then 1.0 else {TAIL.replace('M', '(only_a + only_b)').replace('B', 'only_a').replace('C', 'only_b')} end as p from pc) select count(*) filter (p < 0.05 and d > 0) as gains, count(*) filter (p < 0.05 and d < 0) as losses, round(max(d), 9) as best, round(min(d), 9) as worst, count(*) filter (abs(d) >= 10) as large from v",
    "headroom": f"with {results(7919, 'r')}, h as (select case when snr_db < 'inf'::double then snr_db end as snr_db, round(100 - 100 * avg(correct::int) filter (length_sec = 3), 6) as len3, round(100 - 100 * avg(correct::int) filter (length_sec = 5), 6) as len5, round(100 - 100 * avg(correct::int) filter (length_sec = 10), 6) as len10 from r where is_in_db group by 1) select *, coalesce(greatest(len3, len5, len10) >= 10, false) as usable, case when coalesce(greatest(len3, len5, len10), 0) < 10 then 'saturated' when least(len3, len5, len10) > 80 then 'floor' when len3 >= 10 and len5 >= 10 and len10 >= 10 then 'every' else 'some' end as note from h",
    "knee_probe": f"with {results(7919, 'r')}, c as (select length_sec, snr_db, avg(correct::int) as top1 from r where is_in_db group by 1, 2) select length_sec, max(case when top1 < 0.95 and snr_db < 'inf'::double then snr_db end) as knee_db from c group by 1",
    "winner_histogram": f"with {QUERY}, {matched()} select s.query_id, s.song_id, s.delta, cast(s.score as bigint) as score from smooth s join dec on dec.query_id = s.query_id and dec.pred1 = s.song_id where dec.pred1 <> 0",
    "prune_report": f"with {EVENT_PEAKS}, {paired('ep', 'p')}, c as (select h, count(*) as n from p group by h) select 'before' as stage, count(*) as n_keys, cast(sum(n) as bigint) as n_postings, max(n) as max_len, false as emptied from c union all select 'after', count(*), cast(coalesce(sum(n), 0) as bigint), coalesce(max(n), 0), count(*) = 0 from c where n <= 3",
    "pruning_dry_run": f"with {INDEX}, c as (select h, count(*) as n from postings group by h) select most::bigint as most, count(n) as n_keys, cast(coalesce(sum(n), 0) as bigint) as n_postings, coalesce(max(n), 0) as max_len, count(n) = 0 as emptied from (values (1), (2), (5), (1000000)) l(most) left join c on n <= most group by most",
    "paired_overlap": f"with {results(104729, 'rb')} select count(*) as n_a, count(*) filter (accepted) as n_b, count(*) filter (accepted) as n_common, count(*) > count(*) filter (accepted) as partial from rb",
    "norm_ratio": f"with {results(7919, 'r')}, c as (select length_sec, snr_db, median(norm_score) as m from r where is_in_db group by 1, 2) select length_sec, round(max(m) filter (snr_db = 0) / max(m) filter (snr_db = 'inf'::double), 9) as ratio from c group by 1",
    "knee_manifest": "with s as (select c_custkey as song_id from customer where c_custkey % 10 <> 0), cond(noise_type, snr_db) as (select 'none', null union all select n, b.s from (values ('cafe'), ('traffic'), ('crowd')) a(n), (values (10.0), (5.0), (0.0), (-5.0), (-10.0), (-15.0), (-20.0), (-25.0)) b(s)), m as (select l::double as length_sec, noise_type, snr_db::double as snr_db, row_number() over (order by song_id, l, noise_type <> 'none', noise_type, snr_db desc) as query_id from s, (values (3), (10)) a(l), cond) select length_sec, noise_type, snr_db, count(*) as n, min(query_id) as first, max(query_id) as last from m group by 1, 2, 3",
    "latest_runs": "with r as (select event_type as system, event_id // 100 as run_id, cast(ts as date) as run_on, event_id from events), l as (select system, max(struct_pack(a := run_on, b := run_id)).b as run_id from r group by system) select system, run_id, event_id from r join l using (system, run_id)",
    "holdout_check": f"with {results(7919, 'r')}, k as (select song_id, query_id % 50 as pred1, norm_score, row_number() over (partition by song_id order by norm_score desc, query_id) as k from r where not is_in_db) select song_id, pred1, round(norm_score, 9) as norm_score, norm_score >= 0.15 as suspect from k where k = 1",
    "tau_grid": f"with {results(7919, 'r0')}, x as (select list_sort(list(norm_score)) as xs from r0 where split = 'dev' and snr_db >= 0), q as (select 0.0::double as tau union all select {hazen('xs', '(0.999::double * i / 119)')} from x, unnest(range(0, 120)) u(i)) select distinct round(tau, 9) as tau from q where tau is not null",
    "threshold_sweep": f"with {SWEEP} select tau, rho, tp, n_accepted, n_false_accept, round(precision, 9) as precision, round(recall, 9) as recall, round(far, 9) as far, round(f1, 9) as f1 from s",
    "operating_point": f"with {SWEEP} select tau, rho, round(recall, 9) as recall, round(precision, 9) as precision, round(far, 9) as far from s order by far <= 0.3 desc, case when far > 0.3 then far end nulls first, case when far <= 0.3 then s.recall end desc nulls last, case when far <= 0.3 then s.precision end desc nulls last, tau, rho limit 1",
    "budget_table": f"with {SWEEP} select budget, round(max(recall), 9) as recall from (values (0.05::double), (0.1), (0.2), (0.3), (0.5), (1.0)) b(budget) left join s on far <= budget group by budget",
    "pareto": f"with {SWEEP}, o as (select far, max(recall) as recall from s where far is not null group by far), w as (select *, max(recall) over (order by far rows between unbounded preceding and 1 preceding) as top from o) select round(far, 9) as far, round(recall, 9) as recall from w where top is null or recall > top",
    "split_assign": f"with {CATALOG}, n as (select *, cast(round(count(*) over s * case when role = 'holdout' then 0.5 else 0.2 end) as int) - count(*) filter (split = 'dev') over s as need, row_number() over (partition by role, repertoire, split is null order by md5('42|' || source_path), source_path) as k from cat window s as (partition by role, repertoire)) select source_path, role, repertoire, case when split is not null then split when k <= need then 'dev' else 'test' end as split from n",
    "id_assign": f"with {CATALOG} select source_path, song_id from cat where song_id is not null union all select source_path, greatest(5000, (select max(song_id) from cat)) + row_number() over (order by source_path) from cat where song_id is null",
    "composition": f"with {CATALOG} select repertoire, role, split, grouping_id(repertoire, role, split) as level, count(*) as n from cat group by grouping sets ((repertoire, role, split), (repertoire), ())",
    "merge_prior": "with scan as (select c_name as source_path from customer where c_custkey % 4 <> 0), prior as (select c_name as source_path, c_custkey as song_id, case when c_custkey % 2 = 0 then '' else c_mktsegment end as title, c_custkey % 5 * 400 as year from customer where c_custkey % 3 <> 0) select source_path, coalesce(nullif(title, ''), 'untitled') as title, case when song_id is null then 'unknown' else 'band' end as artist, coalesce(nullif(year, 0), 0) as year, song_id, case when song_id is not null then 'dev' end as split from scan left join prior using (source_path)",
    "retired": "select c_name as source_path, c_custkey as song_id from customer where c_custkey % 3 <> 0 and c_custkey % 4 = 0",
    "work_list": "select event_id::varchar as source_path from events where not (event_id % 3 <> 0 and event_id % 4 > 0 and event_id % 5 - 3 >= -1)",
    "filename_parse": r"""with n as (select p_partkey, (p_partkey % 30) || (case p_partkey % 3 when 0 then '. ' when 1 then ' - ' else ' ' end) || p_brand || (case when p_size % 2 = 0 then ' - ' else ' ' end) || p_name || (case when p_size % 5 = 0 then ' (1987)' else '' end) as s from part),
      a as (select p_partkey, regexp_replace(s, '^\s*\d{1,3}\s*[.\-_)]+\s*', '') as s from n), y as (select p_partkey, regexp_extract(s, '[(\[]((?:19|20)\d{2})[)\]]', 1) as y, trim(regexp_replace(s, '\s*[(\[](?:19|20)\d{2}[)\]]\s*', ' ', 'g'), ' ') as r from a)
      select p_partkey, case when strpos(r, ' - ') > 0 then coalesce(nullif(trim(substr(r, 1, strpos(r, ' - ') - 1)), ''), 'unknown') else 'unknown' end as artist, coalesce(nullif(case when strpos(r, ' - ') > 0 then trim(substr(r, strpos(r, ' - ') + 3)) else r end, ''), 'untitled') as title, coalesce(try_cast(nullif(y, '') as int), 0) as year from y""",
    "path_classify": "select page_id, case page_id % 3 when 0 then 'opm' else 'american' end as repertoire, case page_id % 3 when 1 then 'holdout' else 'db' end as role from pages where page_id % 2 = 0 and page_id % 7 <> 0 and page_id % 3 < 2",
    "catalog_coerce": "select cast(c_custkey as int) as song_id, case when c_custkey % 5 > 0 then c_name else '' end as title, case when c_custkey % 3 = 0 then 'opm' end as repertoire, case when c_custkey % 2 = 0 then 0 else 1999 end as year from customer",
    "missing_noise": "select noise_type from (values ('click'), ('cafe'), ('crowd')) t(noise_type) where noise_type not in (select event_type from events)",
    "sha_catalog": "select doc_id, sha256(text) as sha256 from documents",
    "fnv_tag": "select p_partkey, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(p_name || '|' || p_brand, ''), lambda c: ord(c)::bigint)), lambda h, b: xor(h, b) * 16777619 % 4294967296) as tag from part",
    "preemphasis": f"with {SIGNAL} select clip, i, round(x - 0.97 * coalesce(lag(x) over (partition by clip order by i), 0), 6) as x from sig",
    "rms_normalize": f"with {SIGNAL}, r as (select *, sqrt(avg(x * x) over (partition by clip)) as rms from sig) select clip, i, round(x * case when rms > 0 then 0.1 / rms else 1 end, 6) as x, round(20 * log10(case when rms > 0 then 0.1 / rms else 1 end), 6) as gain_db from r",
    "frame_energy": f"with {FRAMES} select clip, t, round(sum(x * x), 4) as energy from fr group by clip, t",
    "dft_bins": f"with {FRAMES} select clip, t, k2 + 1 as f, round(sqrt(pow(sum(w * x * cos(2 * pi() * k2 * j / 16)), 2) + pow(sum(w * x * sin(2 * pi() * k2 * j / 16)), 2)), 5) as mag from (select *, 0.54 - 0.46 * cos(2 * pi() * j / 15) as w from fr), unnest(range(0, 9)) u(k2) group by clip, t, k2",
    "noise_spectrum": f"with {CELLS}, {NOISE} select clip, f, round(noise, 6) as noise from noise",
    "spectral_subtract": f"with {CELLS}, {NOISE} select clip, t, f, round(greatest(mag - 2.0::double * noise, 0.02::double * mag), 6) as mag from cells join noise using (clip, f)",
    "snr_mix": f"""with {SIGNAL}, nz as (select i as k, x / 500 - 0.1::double as v from sig where clip = 0), a as (select sig.clip, i, x / 1000 as x, case clip % 3 when 0 then 10.0 when 1 then 0.0 else -5.0 end::double as snr, v from sig join nz on k = i % (select count(*) from nz)),
      b as (select *, avg(x * x) over (partition by clip) as px, avg(v * v) over (partition by clip) as pn from a), c as (select *, case when pn = 0 then 0.0 when px = 0 then 1.0 else sqrt(px / (pn * pow(10.0::double, snr / 10))) end as gain from b),
      d as (select *, x + gain * v as y, max(abs(x + gain * v)) over (partition by clip) as top from c) select clip, i, round(case when top > 0.99 then y * 0.99 / top else y end, 6) as x, round(gain, 6) as gain from d""",
    "excerpt_gate": f"with {SIGNAL}, c as (select clip, i, sum(x * x) over (partition by clip order by i rows between current row and 23 following) as total, count(*) over (partition by clip order by i rows between current row and 23 following) as n from sig), e as (select clip, i // 8 as k, sum(x * x) as e, count(*) as n from sig group by 1, 2), md as (select clip, median(e) as m from e where n = 8 group by clip) select clip, i from c join md using (clip) where n = 24 and total * 8 / 24 >= 0.9::double * m",
    "constellation_axes": f"with {CELLS}, {picked('p', 'cells')} select clip, t, f, round((t - 1) / 31.25, 6)::double as seconds, round((f - 1) * 62.5, 6)::double as hz from p",
    "accuracy_series": f"with {results(7919, 'r')}, c as (select length_sec, snr_db, avg(correct::int) as top1 from r where is_in_db group by 1, 2) select length_sec, round(top1, 9) as top1, case when snr_db < 'inf'::double then snr_db else (select max(snr_db) from c where snr_db < 'inf'::double) + 5 end as x from c",
    "repertoire_confusion": "select a.c_mktsegment as repertoire, coalesce(b.c_mktsegment, 'none') as predicted, count(*) as n from orders join customer a on a.c_custkey = o_custkey left join customer b on b.c_custkey = o_orderkey % 40 group by all",
    "systematic_sample": "with r as (select s_suppkey, row_number() over (order by s_suppkey) as i, count(*) over () as n from supplier) select s_suppkey from r where i in (select cast(round(1 + k * (n - 1) / 6.0::double) as int) from range(0, 7) t(k))",
    "wav_selfmatch": "select user_id as query_id, user_id as pred1, true as accepted from events group by user_id",
    "enrol_gate": "select 1.0::double as top1, true as passed from events having count(*) > 0",
    "peak_budget": _budget(),
    "query_config": _query_config(),
    "system_registry": _registry(),
}
