"""DuckDB SQL for the queries, over views named as the tables."""

from __future__ import annotations

#: Twelve decimals keep simple fractions on their side of a threshold.
PEARSON = "case when count(*) >= 2 and stddev_pop(x) * stddev_pop(y) > 1e-12 then round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 12) end"

#: White space as text has it, beyond ASCII included.
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Common table expressions that the statements below share.
SHARED = f"""
with feed as (
    select user_id, cast(props->>'$.k' as integer) as film, ts, event_id,
        case when event_type <> 'error' then cast(least(10, greatest(1, ceil(value / 8))) as double) / 2 end as rating, event_type = 'purchase' as liked,
        row_number() over (partition by user_id order by ts desc, event_id desc) as pos from events),
ratings as (
    select user_id, film, rating, ts, case when pos <= 20 then 'feed' else 'grid' end as source from feed where rating is not null
    qualify row_number() over (partition by user_id, film order by case when pos <= 20 then 0 else 1 end, case when pos <= 20 then -pos else pos end) = 1),
hist as (select film, rating as stars, count(*) as n from ratings group by all),
cat0 as (select film, cast(sum(n) as bigint) as lb_total, cast(coalesce(sum(n) filter (stars >= 4), 0) as bigint) as raters_ge4 from hist group by film),
cat as (select *, cast(ceil(raters_ge4 / 25.0) as bigint) as pages_ge4, cast(ceil(lb_total / 25.0) as bigint) as pages_all from cat0),
crowd as (select film, sum(stars * n) / sum(n) as lb_avg from hist group by film),
idfs as (select *, ln(sum(lb_total) over () / greatest(lb_total, 1)) as idf, pages_ge4 <= 2000 and raters_ge4 >= 3 as eligible from cat),
planned0 as (select *, cast(sum(pages_ge4) over (partition by eligible order by pages_ge4, film rows unbounded preceding) as bigint) as running from idfs),
planned as (select *, eligible and 100 * running <= 20 * sum(pages_ge4) over (partition by eligible) as chosen from planned0),
seeds as (select film, idf from planned where chosen),
edges as (
    select distinct e.user_id, e.film, e.kind, s.idf from (
        select user_id, film, 'rated' as kind from ratings where rating >= 4 union all select user_id, film, 'liked' from feed where liked) e join seeds s using (film)),
candidates as (
    select user_id, round((select sum(d.idf) from (select distinct e2.film, e2.idf from edges e2 where e2.user_id = e.user_id) d), 6) as score,
        count(distinct film) as n_seeds, array_to_string(list_transform(list_sort(list(distinct film)), lambda x: cast(x as varchar)), ',') as seeds,
        array_to_string(list_sort(list(distinct kind)), ',') as via
    from edges e group by user_id),
mine as (select film, rating as my_rating from ratings where film in (select film from seeds) and user_id = (select min(user_id) from ratings)),
agree as (
    select user_id, count(*) as n_shared, round(avg(rating - my_rating), 3) as mean_gap, round(avg(case when abs(rating - my_rating) <= 0.5 then 1.0 else 0.0 end), 3) as agree_rate, round(avg(rating), 3) as their_mean
    from ratings join mine using (film) group by user_id having count(*) >= 2),
split as (
    select r.*, f.film is not null as is_test from ratings r left join (select distinct user_id, film from feed where pos <= 20) f using (user_id, film)
    where r.film not in (select film from seeds)),
pct as (
    select user_id, film, rating, pct from (
        select user_id, film, rating, count(*) over (partition by user_id) as n,
            (rank() over (partition by user_id order by rating) - 1 + (count(*) over (partition by user_id, rating) - 1) / 2.0) / nullif(count(*) over (partition by user_id) - 1, 0) as pct from ratings)
    where n > 1),
pct0 as (select * from pct where film not in (select film from seeds)),
agreement0 as (select p.a, p.b, count(*) as n_common, {PEARSON} as r from (select l.user_id as a, q.user_id as b, l.pct as x, q.pct as y from pct0 l join pct0 q using (film) where l.user_id < q.user_id) p group by p.a, p.b),
verdict as (select *, case when n_common < 8 then 'insufficient' when r >= 0.5 then 'twin' when r <= -0.4 then 'mirror' else 'unrelated' end as verdict from agreement0),
train as (select * from split where not is_test),
mu as (select user_id, avg(rating) as mu from train group by user_id),
nu as (select user_id, avg(rating) as nu from ratings group by user_id),
weights as (
    select a, b, r as w from (
        select a, b, count(*) as n, {PEARSON} as r from (select t.user_id as a, h.user_id as b, t.rating as x, h.rating as y from train t join ratings h using (film) where t.user_id <> h.user_id) group by a, b)
    where n >= 5 and abs(r) >= 0.15),
cf0 as (
    select t.user_id, t.film, t.rating as actual, sum(abs(w)) as norm, sum(w * (h.rating - nu)) as moved
    from split t join weights on t.user_id = a join ratings h on h.user_id = b and h.film = t.film join nu on nu.user_id = b where t.is_test group by all),
cf as (select user_id, film, actual, mu + moved / norm as raw, greatest(0.5, least(5.0, mu + moved / norm)) as pred from cf0 join mu using (user_id) where norm > 0),
test as (select t.user_id, t.film, t.rating as actual, mu, lb_avg, (select avg(lb_avg) from crowd) as overall from split t join mu using (user_id) left join crowd using (film) where t.is_test),
base as (
    select 'global mean' as model, user_id, film, overall as pred, actual from test union all select 'user mean', user_id, film, mu, actual from test
    union all select 'crowd average', user_id, film, lb_avg, actual from test where lb_avg is not null
    union all select 'user + crowd', user_id, film, mu + lb_avg - overall, actual from test where lb_avg is not null),
preds as (select model, user_id, film, pred, actual from base union all select 'neighbour cf', user_id, film, pred, actual from cf),
drawn as (select *, md5(concat_ws(':', user_id, film, '7')) as draw from ratings),
placed as (select *, row_number() over (order by draw, user_id, film) as place, count(*) over () as n from drawn),
parts as (select *, case when place <= floor(0.7::double * n) then 'train' when place <= floor(0.85::double * n) then 'cal' else 'test' end as part from placed),
bmu as (select avg(rating) as bmu from parts where part = 'train'),
bi as (select film, sum(rating - bmu) / (count(*) + 25) as bi from parts, bmu where part = 'train' group by film),
bu as (select user_id, sum(rating - bmu - bi) / (count(*) + 10) as bu from parts join bi using (film), bmu where part = 'train' group by user_id),
scored as (select user_id, film, part, bmu + coalesce(bu, 0) + coalesce(bi, 0) as score, cast(rating >= 4 as integer) as label, draw from parts left join bi using (film) left join bu using (user_id), bmu where part <> 'train'),
naive as (select 'linear' as model, user_id, film, label, (score - 1) / 4 as p from scored where part = 'test' union all select 'sigmoid', user_id, film, label, 1 / (1 + exp(-(score - 3.5))) from scored where part = 'test'),
arms as (
    select p.*, case when n_seeds >= 3 then 'treatment' when n_seeds = 1 then 'control' when n_seeds = 2 then 'between' else 'none' end as arm from (
        select a, b, count(*) as n_common, case when count(*) >= 8 then {PEARSON} end as r
        from (select l.user_id as a, q.user_id as b, l.rating as x, q.rating as y from ratings l join ratings q using (film) where l.user_id < q.user_id and film not in (select film from seeds)) group by a, b) p
    left join (select l.user_id as a, q.user_id as b, count(*) as n_seeds from ratings l join ratings q using (film) where l.user_id < q.user_id and film in (select film from seeds) group by all) s using (a, b)),
summary as (
    select arm, count(*) as n_attempted, count(r) as n, count(*) filter (r >= 0.5) as twins, count(*) filter (r <= -0.4) as mirrors, round(avg(r), 6) as mean_r, round(avg(abs(r)), 6) as mean_abs,
        count(*) filter (r is not null and n_common >= 15) as hi_n, count(*) filter (r >= 0.5 and n_common >= 15) as hi_twins, round(avg(r) filter (n_common >= 15), 6) as hi_mean_r,
        list_sort(list(n_common) filter (r is not null))[cast(count(r) // 2 + 1 as bigint)] as median_common,
        round(coalesce(count(r) / count(*), 0), 6) as scorable, coalesce(round(count(*) filter (r >= 0.5) / nullif(count(r), 0), 6), 0) as twin_rate
    from arms group by arm),
users as (select user_id, count(distinct film) as n_films from feed group by user_id),
follows as (
    select src, dst, place, n_films from (select user_id as src, (user_id * 7 + place * 13) % (select max(user_id) + 1 from users) as dst, place from users, (select unnest(range(1, 16)) as place)) e
    join users on users.user_id = dst where src <> dst),
hosted as (select *, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host from pages),
urls as (
    select url, 200 as status from pages union all values ('https://a.example/u/rss/', 200), ('https://a.example/u/films/page/2/', 200), ('https://a.example/film/x/reviews/', 200),
    ('https://a.example/u/following/', 200), ('https://a.example/film/x/', 200), ('https://a.example/film/x/', 500), ('https://a.example/about', 200)),
routed as (
    select url, status, case when status not between 200 and 299 then 'non200' when contains(url, '/rss/') then 'rss' when contains(url, '/reviews/') then 'reviews'
        when contains(url, '/following/') or contains(url, '/followers/') then 'people' when contains(url, '/films/') then 'films' when contains(url, '/film/') then 'film_ids' else 'other' end as kind from urls),
store as (
    select url, max_by(status, fetched_at) as status, max_by(body, fetched_at) as body, max_by(transport, fetched_at) as transport, max(fetched_at) as fetched_at from (
        select url, html as body, case when page_id % 7 = 3 then 404 when page_id % 11 = 5 then 503 else 200 end as status, case when page_id % 3 = 0 then 'browser' else 'http' end as transport, 1000000.0::double - 600.0::double * page_id as fetched_at from pages) group by url),
paged as (
    select user_id, page, case when (user_id * 7 + page * 3) % 19 = 0 then 404 else 200 end as status, case when (user_id * 7 + page * 3) % 29 = 0 then 0 else n end as n_rows from (
        select user_id, page, count(*) as n from (select user_id, (row_number() over (partition by user_id order by film) - 1) // 5 + 1 as page from ratings) group by user_id, page) where (user_id * 7 + page * 3) % 23 <> 0),
levels as (select user_id, rating, count(*) as c, count(*) / sum(count(*)) over (partition by user_id) as p from ratings group by user_id, rating),
labels_of as (
    select user_id, n, like_rate, sd, entropy from (select user_id, count(*) as n, round(avg(case when rating >= 4 then 1.0 else 0.0 end), 6) as like_rate, round(stddev_pop(rating), 6) as sd from ratings group by user_id having count(*) >= 20)
    join (select user_id, round(-sum(p * log2(p)), 6) as entropy from levels group by user_id) using (user_id))
"""


def _ranked(source: str, by: str, pred: str, positive: str) -> str:
    return f"""select {by}, round((sum(case when y then rk end) - sum(cast(y as double)) * (sum(cast(y as double)) + 1) / 2) / nullif(sum(cast(y as double)) * sum(1.0 - cast(y as double)), 0), 6) as auc from (
        select {by}, {positive} as y, rank() over (partition by {by} order by {pred}) + (count(*) over (partition by {by}, {pred}) - 1) / 2.0 as rk from {source}) group by {by}"""


def _calibration(source: str) -> str:
    return f"""select * from (
        select model, round(avg((q - label) * (q - label)), 6) as brier, round(avg(-case when label = 1 then ln(q) else ln(1 - q) end), 6) as logloss from q group by model)
        join (select model, round(sum(n * abs(mp - my)) / sum(n), 6) as ece from (select model, least(9, floor(q * 10)) as bin, count(*) as n, avg(q) as mp, avg(label) as my from q group by all) group by model) using (model)
        join ({_ranked("(select model, round(q, 9) as q9, label from q)", "model", "q9", "label = 1")}) using (model)""".replace("from q ", f"from (select model, label, greatest(1e-6, least(1 - 1e-6, p)) as q from {source}) ").replace("from q)", f"from (select model, label, greatest(1e-6, least(1 - 1e-6, p)) as q from {source}))")


def _paired(metric: str) -> str:
    return f"""select user_id, round(sqrt(avg((pred - actual) * (pred - actual))), 6) as rmse from {metric} group by user_id"""


#: The best temperature of the grid on the calibration part, applied to the test part.
_TEMPERATURE = """(select 'temperature' as model, label, 1 / (1 + exp(-(score - 3.5) / t)) as p from scored, (
    select t from (select round(score, 4) as s, label, count(*) as n from scored where part = 'cal' group by all), (select exp(-2.995732 + i * (5.991465 / 400)) as t from range(401) r(i))
    group by t order by sum(-n * case when label = 1 then ln(greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(s - 3.5) / t))))) else ln(1 - greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(s - 3.5) / t))))) end), t limit 1) where part = 'test')"""
_STEPS = 8


def _newton(k: int) -> str:
    p = "1 / (1 + exp(-(w * x + b)))"
    return f"""k{k + 1} as (
        select size, w - (bb * gw - wb * gb) / (ww * bb - wb * wb) as w, b - (ww * gb - wb * gw) / (ww * bb - wb * wb) as b from (
            select size, w, b, sum((n * {p} - pos) * x) + w as gw, sum(n * {p} - pos) as gb, sum(n * {p} * (1 - {p}) * x * x) + 1 as ww, sum(n * {p} * (1 - {p}) * x) as wb, sum(n * {p} * (1 - {p})) as bb
            from pts join k{k} using (size) group by size, w, b))"""


#: Platt's fit by Newton steps, and the isotonic one by its max-min formula over sums up to each score: the largest over all
#: starts of the smallest mean over all ends. Both for each size of the calibration sample; test rows hold every size.
def _fits(sizes: str) -> str:
    return f"""
        cal as (select round(score, 9) as x, label, row_number() over (order by draw, user_id, film) as place from scored where part = 'cal'),
        sizes as (select unnest([{sizes}]) as size),
        pts as (select size, x, cast(count(*) as bigint) as n, cast(sum(label) as bigint) as pos from cal join sizes on place <= size group by size, x),
        k0 as (select size, 0.0::double as w, ln(sum(pos) / (sum(n) - sum(pos))) as b from pts group by size having sum(pos) > 0 and sum(pos) < sum(n)),
        {", ".join(map(_newton, range(_STEPS)))},
        upto as (select size, x, row_number() over w as i, sum(n) over w as cn, sum(pos) over w as cp, sum(n) over w - n as bn, sum(pos) over w - pos as bp from pts window w as (partition by size order by x rows unbounded preceding)),
        low as (select j.size, j.i as j, k.i as i, min((k.cp - j.bp)::double / (k.cn - j.bn)) over (partition by j.size, j.i order by k.i desc rows unbounded preceding) as v from upto j join upto k on j.size = k.size and k.i >= j.i),
        curve as (select size, x, y, lead(x) over (partition by size order by x) as nx, lead(y) over (partition by size order by x) as ny, row_number() over (partition by size order by x) as i from (
            select u.size, u.x, max(l.v) as y from upto u join low l on u.size = l.size and u.i = l.i group by u.size, u.x)),
        asked as (select size, round(score, 9) as s, label from scored, sizes where part = 'test'),
        fitted as (
            select size, 'platt' as model, 1 / (1 + exp(-(w * s + b))) as p, label from asked join k{_STEPS} using (size)
            union all select a.size, 'isotonic', case when s < x or nx is null then y else y + (ny - y) * (s - x) / (nx - x) end, label
            from asked a join curve c on a.size = c.size and (s >= x or i = 1) and (s < nx or nx is null))"""


def _fitted(model: str) -> str:
    return "select * from (with " + _fits("1000000000") + _calibration(f"(select * from fitted where model = '{model}')").replace("select * from (", " select * from (", 1) + ")"


_SWEEP = f"""select * from (with {_fits("50, 100, 200, 500, 1000, 5000")}, q as (select size, model, greatest(1e-6, least(1 - 1e-6, p)) as p, label from fitted),
    bins as (select size, model, least(9, floor(p * 10)) as bin, count(*) as n, avg(p) as mp, avg(label) as my from q group by all)
    select cast(size as integer) as size, model, n_test, brier, ece, n_cal from (select size, model, count(*) as n_test, round(avg((p - label) * (p - label)), 6) as brier from q group by size, model)
    join (select size, model, round(sum(n * abs(mp - my)) / sum(n), 6) as ece from bins group by size, model) using (size, model)
    join (select size, cast(sum(n) as bigint) as n_cal from pts group by size) using (size))"""
_LN_P = "exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1))"
_COHORT = f"""select user_id, n_scored, n_neighbours, auc_cf, auc_user, round(n_scored / n_test, 6) as coverage from (select user_id, count(*) filter (is_test) as n_test, count(*) filter (not is_test) as n_train from split group by user_id)
    join (select user_id, count(*) as n_scored from cf group by user_id) using (user_id) join (select a as user_id, count(*) as n_neighbours from weights group by a) using (user_id)
    join (select user_id, auc as auc_cf from ({_ranked("(select user_id, round(pred, 9) as p9, actual from cf)", "user_id", "p9", "actual >= 4")})) using (user_id)
    join (select user_id, auc as auc_user from ({_ranked("(select user_id, round(mu, 9) as p9, actual from cf join mu using (user_id))", "user_id", "p9", "actual >= 4")})) using (user_id) where n_test >= 8 and n_train >= 20 and n_scored >= 8"""

STATEMENTS: dict[str, str] = {
    "percentile_agreement": "select a, b, n_common, round(r, 6) + 0.0::double as r from agreement0 where n_common >= 8",
    "diary_feed": """
        select 'https://s.example/' || user_id || '/rss/' as url, cast(pos - 1 as integer) as pos, skipped, case when not skipped then 'Film ' || film end as film_title,
            case when not skipped and film % 4 <> 0 then cast(1950 + film % 70 as integer) end as film_year, case when not skipped and film % 3 <> 0 then cast(film * 10 + 7 as bigint) end as tmdb_id,
            case when not skipped and (event_id % 3 = 0 or rating >= 1) then rating end as rating, case when not skipped then strftime(ts, '%Y-%m-%d') end as watched_date, not skipped and event_id % 5 = 0 as rewatch, not skipped and liked as liked,
            case when not skipped then 'film-' || film end as slug, case when not skipped then '<p>Seen &amp; noted ' || event_id || '</p>' end as review_text
        from (select *, event_id % 13 = 5 as skipped from feed where pos <= 20)""",
    "films_grid": """
        select 'https://s.example/' || user_id || '/films/' || case when k < 72 then '' else 'page/' || (k // 72 + 1) || '/' end as url, cast(k % 72 + 1 as integer) as pos, 'film-' || film as slug, 'Film &amp; ' || film as title,
            case when film % 5 <> 0 then cast(1950 + film % 70 as integer) end as year, cast(film as bigint) as film_id, case when film % 7 <> 0 then rating end as rating from (select *, row_number() over (partition by user_id order by film) - 1 as k from ratings)""",
    "people_list": """
        select 'https://s.example/' || src || '/following/' as url, cast(row_number() over (partition by src order by place) - 1 as integer) as pos, 'u' || dst as username, 'User & ' || dst as display_name,
            cast(n_films * 100 as bigint) as n_films, cast(dst * 977 as bigint) as n_followers from follows""",
    "review_rows": f"""
        select 'https://s.example/film/alpha/reviews/by/activity/' || case when doc_id < 12 then '' else 'page/' || (doc_id // 12 + 1) || '/' end as url, cast(row_number() over (partition by doc_id // 12 order by doc_id) - 1 as integer) as pos,
            'u' || doc_id as username, 'User ' || doc_id as display_name, case when doc_id % 11 <> 0 then (doc_id % 10 + 1) / 2 end as rating, doc_id % 4 = 0 as liked, doc_id % 9 = 0 or contains(coalesce(text, ''), 'may contain spoilers') as spoiler,
            '2024-02-' || lpad(cast(doc_id % 28 + 1 as varchar), 2, '0') as date, t as text, suffix(t, '…') as truncated, '/s/full-text/viewing:' || doc_id || '/' as full_text_url, doc_id as viewing_id, doc_id * 3 as n_comments, doc_id * 7 as n_likes
        from (select doc_id, text, trim(regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g')) as t from documents)""",
    "rating_histogram_page": "select 'https://s.example/csi/film/' || film || '/rating-histogram/' as url, stars, cast(n * 1003 as bigint) as n from hist",
    "film_page_ids": """
        select 'https://s.example/film/' || film || '/' as url, case when film % 8 <> 0 then cast(film * 3 + 1 as bigint) end as tmdb_id, case when film % 6 = 0 then 'tv' else 'movie' end as tmdb_type,
            'tt' || lpad(cast(film as varchar), 7, '0') as imdb_id, 'https://a.ltrbxd.com/resized/film-poster/' || film || '-alpha-0-125-0-187-crop.jpg' as poster from cat""",
    "members_page": "select 'https://s.example/' || src || '/following/' as url, 'u' || dst as username from (select distinct src, dst from follows)",
    "route_records": """
        select 'rss' as kind, count(distinct user_id) as pages, count(*) filter (event_id % 13 <> 5) as records from feed where pos <= 20
        union all select 'films', count(distinct (user_id, k // 72)), count(*) from (select user_id, row_number() over (partition by user_id order by film) - 1 as k from ratings)
        union all select 'people', count(distinct src), count(*) from follows union all select 'reviews', count(distinct doc_id // 12), count(*) from documents
        union all select 'film_ids', count(*), count(*) filter (film % 8 <> 0) from cat where film % 10 <> 0
        union all select 'non200', count(*), 0 from cat where film % 10 = 0 having count(*) > 0""",
    "page_store_scan": "select url, status, transport, fetched_at, length(body) as n_chars, md5(body) as body_md5, false as damaged from store",
    "histogram_artifacts": "select cast(film as varchar) as film, stars, cast(n as bigint) as n from hist where film % 5 <> 4",
    "candidates_artifact": "select user_id, score, n_seeds, seeds, via from candidates",
    "seed_file": "select 'film-' || film as slug from seeds",
    "ratings_file": "select cast(user_id as varchar) as user, cast(film as varchar) as item, rating, cast(floor(epoch(ts)) as bigint) as ts from ratings",
    "probe_verdicts": "select case when cast(round(fetched_at / 600) as bigint) % 5 = 0 then '?' when status between 200 and 299 and transport = 'browser' then 'browser' when status between 200 and 299 then 'http' else 'BLOCKED' end as verdict, count(*) as n from store group by 1",
    "image_topup": "select distinct regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/' || substr(sha256(url), 1, 2) || '/' || sha256(url) as key, '1F8B' as magic from pages where strpos(url, '?') = 0",
    "members_stream": "select distinct 'https://s.example/' || src || '/following/' as url, 'u' || dst as username from follows",
    "page_lookup": "select url, status, length(body) as n_chars from store where url = (select min(url) from pages) and (status = 200 or 1000000.0 - fetched_at <= 21600)",
    "anti_cached": "select distinct url from pages where url not in (select url from pages where strpos(url, '?') = 0)",
    "text_summary": "select lang, count(*) as n, count(quality) as n_rated, round(avg(quality), 6) as mean_quality, count(*) filter (length(trim(text)) > 0) as with_text, count(*) filter (suffix(text, '…')) as truncated, count(*) filter (toxic = 1) as toxic from documents left join labels using (doc_id) group by lang",
    "cache_freshness": "select url, status between 200 and 299 or 1000000.0 - fetched_at <= 21600 as usable, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/' || substr(sha256(url), 1, 2) || '/' || sha256(url) as key from store",
    "cache_stats": "select count(*) as entries, count(*) filter (status between 200 and 299) as ok, count(*) filter (status not between 200 and 299) as failed from store",
    "ordered_dedup": "select trim(regexp_replace(url, '[?#].*$', '')) as url, min(page_id) as pos from pages where trim(regexp_replace(url, '[?#].*$', '')) <> '' and url not like '#%' group by 1",
    "paginated_scan": """
        select user_id, last, why, (select count(*) from paged p where p.user_id = e.user_id and p.page <= last) as n, cast(coalesce((select sum(n_rows) from paged p where p.user_id = e.user_id and p.page <= last), 0) as bigint) as films from (
            select user_id, cast(stop - 1 as bigint) as last, case when stop = 9 then 'cap' when stop = failed then 'failed' when stop = empty then 'empty' else 'missing' end as why from (
                select user_id, failed, empty, least(failed, empty, 9, gap) as stop from (
                    select user_id, coalesce(min(page) filter (status <> 200), 99) as failed, coalesce(min(page) filter (status = 200 and n_rows = 0), 99) as empty, (select min(i) from (select unnest(range(1, 100)) as i) where (user_id, i) not in (select (user_id, page) from paged)) as gap from paged group by user_id))) e""",
    "url_builders": "select distinct user_id, film, '/' || user_id || '/films/' || case when film = 1 then '' else 'page/' || film || '/' end as path from feed",
    "field_coverage": "select user_id, field, coverage from (select user_id, unnest(['film', 'rating', 'liked_true']) as field, unnest([round(avg(case when film is not null then 1.0 else 0.0 end), 3), round(avg(case when rating is not null then 1.0 else 0.0 end), 3), round(avg(case when liked then 1.0 else 0.0 end), 3)]) as coverage from feed group by user_id) where coverage > 0",
    "star_glyph_parse": """
        select event_id, case when k = 0 and rating >= 1 then rating when k = 2 and rating >= 1 then rating end as title_rating,
            case when rating is null or k = 3 then null when k = 2 then rating + 1 else rating end as glyph_rating from (select *, event_id % 4 as k from feed)""",
    "html_strip_tags": "select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '" + _SPACE + "+', ' ', 'g')) as text from pages",
    "url_token_decode": """
        select distinct 'https://s.example/film/' || film || '/members/rated/' || case when film % 17 = 0 then '6/' else
            case when stars >= 1 then cast(cast(floor(stars) as integer) as varchar) else '' end || case when stars % 1 <> 0 then '%C2%BD' else '' end || '/' || case when film % 3 = 0 then '' else 'page/' || (film % 3 + 1) || '/' end end as url,
            cast(film as varchar) as film, case when film % 17 <> 0 then stars end as stars from hist""",
    "url_route": "select url, status, kind from routed",
    "route_counts": "select kind, count(*) as n, count(distinct url) as urls from routed group by kind",
    "seed_eligibility": "select film, raters_ge4, pages_ge4, eligible, case when chosen then 'yes' when pages_ge4 > 2000 then 'too big' when raters_ge4 < 3 then 'pool<3' else 'budget' end as reason from planned",
    "seed_modes": """
        select mode, film, total, pool, pages, eligible, eligible and 100 * running <= 20 * whole as chosen from (
            select *, sum(pages) over (partition by mode, eligible order by pages, film rows unbounded preceding) as running, sum(pages) over (partition by mode, eligible) as whole from (
                select *, pages <= 2000 and (mode = 'territory' or pool >= 3) as eligible from (
                    select film, total, unnest(['taste', 'territory', 'both']) as mode, unnest([pool, total, greatest(pool, total)]) as pool, unnest([pages, whole, pages + whole]) as pages from (
                        select film, cast(sum(n) as bigint) as total, cast(coalesce(sum(n) filter (stars >= 4), 0) as bigint) as pool, cast(coalesce(sum(ceil(n / 25.0)) filter (stars >= 4), 0) as bigint) as pages, cast(ceil(sum(n) / 25.0) as bigint) as whole from hist group by film))))""",
    "prescreen": """
        select user_id, place, requests, eligible, cast(spent as bigint) as spent, cast(found as bigint) as found, case when eligible then friend_pages end as friend_pages from (
            select *, sum(requests) over (order by place) as spent, sum(cast(eligible as integer)) over (order by place) as found, count(*) over () // 3 as want from (
                select *, cast(1 + cast(a as integer) + cast(a and b as integer) as bigint) as requests, a and b and c as eligible from (
                    select user_id, row_number() over (order by md5(concat_ws(':', user_id, '0', '7')), user_id) as place, friend_pages, user_id % 13 <> 0 and coalesce(n_friends, 0) >= 15 as a, user_id % 17 <> 0 and n_recent >= 17 as b, user_id % 19 <> 0 and n_rated >= 30 as c
                    from (select distinct user_id from ratings where rating >= 4 and film in (select film from cat order by lb_total desc, film limit 20))
                    left join (select src as user_id, count(*) as n_friends, cast(sum(least(8, ceil(n_films / 72.0))) filter (k <= 15) as bigint) as friend_pages from (
                        select *, row_number() over (partition by src order by n_films desc, dst) as k from (select distinct src, dst, n_films from follows)) group by src) using (user_id)
                    join (select user_id, count(rating) filter (pos <= 20) as n_recent from feed group by user_id) using (user_id) join (select user_id, least(count(*), 72) as n_rated from ratings group by user_id) using (user_id))))
        where found - cast(eligible as integer) < want""",
    "pool_band": "select film, raters_ge4, case when raters_ge4 < 15 then 'small' when raters_ge4 > 60 then 'big' else 'sweet' end as band from cat",
    "verdicts": "select verdict, count(*) as n from verdict group by verdict",
    "eligible_targets": "select user_id, count(*) filter (is_test) as n_test, count(*) filter (not is_test) as n_train from split group by user_id having count(*) filter (is_test) >= 5 and count(*) filter (not is_test) >= 10",
    "co_rated_pairs": "select l.user_id as a, r.user_id as b, count(*) as n_common from ratings l join ratings r using (film) where l.user_id < r.user_id group by all",
    "seed_exclusion": "select user_id, film, rating from ratings where film not in (select film from seeds)",
    "friends_of_friends": "select x.src, y.dst, count(*) as paths from follows x join follows y on x.dst = y.src where x.src <> y.dst and not exists (select 1 from follows z where z.src = x.src and z.dst = y.dst) group by all",
    "heart_bump": "select user_id, film, case when liked and rating >= 3.5 and rating < 4 then 4.0 else rating end as rating from (select r.user_id, r.film, r.rating, exists (select 1 from feed f where f.liked and f.user_id = r.user_id and f.film = r.film) as liked from ratings r)",
    "fulltext_backfill": "select doc_id, text, coalesce(length(text) > 200, false) as truncated from documents",
    "film_histogram": "select film, stars, n from hist",
    "film_pool_cost": "select film, lb_total, raters_ge4, pages_ge4, pages_all from cat",
    "crowd_average": "select film, round(lb_avg, 6) as lb_avg from crowd",
    "cooccurrence_score": "select user_id, score, n_seeds, seeds, via from candidates",
    "shared_seed_distribution": "select n_seeds, count(*) as n from candidates group by n_seeds",
    "seed_agreement": "select user_id, n_shared, mean_gap, agree_rate, their_mean from agree",
    "population_gap": "select count(*) as n, round(avg(mean_gap), 6) as mean_gap, round(avg(agree_rate), 6) as agree_rate from agree",
    "rating_profile": """
        select user_id, n_total, n_rated, round(coalesce(n_rated / nullif(n_total, 0), 0), 3) as rate_fraction, round(m, 3) as mean, round(s, 3) as sd, round(top, 3) as modal_share, round(e, 3) as entropy_norm, uses_half_stars, reason = 'ok' as usable, reason
        from (select *, case when n_rated = 0 then 'no ratings at all' when why = '' then 'ok' else why end as reason from (
            select *, array_to_string(list_filter([case when s < 0.5 then 'sd too low' end, case when top > 0.5 then 'single value' end, case when n_rated < 30 then 'few ratings' end], lambda x: x is not null), '; ') as why from (
                select user_id, count(*) as n_total, count(rating) as n_rated, avg(rating) as m, stddev_pop(rating) as s, coalesce(bool_or(rating % 1 <> 0), false) as uses_half_stars from feed group by user_id)
            left join (select user_id, max(p) as top, -sum(p * ln(p)) / ln(10) as e from (select user_id, count(*) / sum(count(*)) over (partition by user_id) as p from feed where rating is not null group by user_id, rating) group by user_id) using (user_id)))""",
    "host_counts": "select host, count(*) as n from hosted group by host",
    "user_rating_histogram": "select user_id, rating, n, cast(round(40 * n / max(n) over (partition by user_id), 0) as integer) as bar from (select u.user_id, u.rating, count(r.film) as n from (select distinct user_id, unnest(range(1, 11)) / 2.0::double as rating from ratings) u left join ratings r on r.user_id = u.user_id and r.rating = u.rating group by all)",
    "fetch_cost": "select src, cast(sum(n_films) as bigint) as films, cast(sum(ceil(n_films / 20.0)) as bigint) as pages from follows group by src",
    "capped_fetch_cost": "select src, cast(sum(least(4, ceil(n_films / 10.0))) as bigint) as pages from follows group by src",
    "arm_summary": "select * from summary",
    "cohort_distribution": f"""
        select metric, count(*) as n, round(median(v), 6) as median, list_sort(list(v))[cast(floor(count(*) * 0.25) as bigint) + 1] as lower, list_sort(list(v))[cast(floor(count(*) * 0.75) as bigint) + 1] as upper, count(*) filter (won) as wins, count(*) filter (good) as good from (
            select unnest(['auc_cf', 'auc_user', 'coverage', 'n_neighbours']) as metric, unnest([auc_cf, auc_user, coverage, cast(n_neighbours as double)]) as v, auc_cf > auc_user as won, auc_cf > 0.7 as good from ({_COHORT}) where auc_cf is not null and auc_user is not null) group by metric""",
    "bias_model": """
        select 'film' as kind, cast(film as bigint) as id, round(b, 6) as bias from (select film, sum(rating - m) / (count(*) + 25) as b from ratings, (select avg(rating) as m from ratings) group by film)
        union all select 'user', user_id, round(sum(rating - m - b) / (count(*) + 10), 6) from ratings join (select film, m, sum(rating - m) / (count(*) + 25) as b from ratings, (select avg(rating) as m from ratings) group by film, m) using (film) group by user_id""",
    "user_label_stats": "select user_id, n, like_rate, sd, entropy from labels_of",
    "positional_quantiles": "select " + ", ".join(f"list_sort(list({c}))[cast(floor(count(*) * {p}) as bigint) + 1] as {c}_{int(p * 100)}" for c in ("like_rate", "entropy", "sd") for p in (0.1, 0.5, 0.9)) + " from labels_of",
    "selection_budget": "select count(*) as films, cast(sum(pages_ge4) as bigint) as pages, round(sum(idf), 6) as idf, round(sum(pages_ge4) * 4.5::double / 3600, 6) as hours, round(sum(pages_ge4) * 0.0229::double, 6) as megabytes, round(sum(pages_ge4) * 0.0229::double / 1000 * 0.7, 6) as dollars from planned where chosen",
    "coverage_pivot": """
        select field, coalesce(max(coverage) filter (event_type = 'click'), 0.0) as click, coalesce(max(coverage) filter (event_type = 'error'), 0.0) as error, coalesce(max(coverage) filter (event_type = 'purchase'), 0.0) as purchase,
            coalesce(max(coverage) filter (event_type = 'signup'), 0.0) as signup, coalesce(max(coverage) filter (event_type = 'view'), 0.0) as view from (
            select event_type, unnest(['value', 'props', 'user_id']) as field, unnest([round(count(value) / count(*), 3), round(count(props) / count(*), 3), round(count(user_id) / count(*), 3)]) as coverage from events group by event_type) where coverage > 0 group by field""",
    "midrank_percentile": "select user_id, film, round(pct, 6) as pct from pct",
    "history_merge": "select user_id, film, rating, source from ratings",
    "greedy_budget": "select film, pages_ge4, running, chosen from planned",
    "leave_last_out": "select user_id, film, row_number() over (partition by user_id order by ts desc, film) = 1 as is_test from ratings",
    "ndcg_at_k": """
        select model, user_id, round(dcg / ideal, 6) as ndcg from (select model, user_id, min(g) as low, max(g) as high, sum(case when place <= 5 then g / log2(place + 1) else 0 end) as dcg, sum(case when best <= 5 then g / log2(best + 1) else 0 end) as ideal from (
            select *, row_number() over (partition by model, user_id order by g desc, place) as best from (
                select model, user_id, case when actual >= 4 then 1.0 else 0.0 end as g, row_number() over (partition by model, user_id order by round(pred, 9) desc, film) as place from preds)) group by all) where low < high""",
    "running_cost": "select src, pages, cast(sum(pages) over (order by src rows unbounded preceding) as bigint) as running from (select src, cast(sum(least(8, ceil(n_films / 72.0))) as bigint) as pages from follows group by src)",
    "top_twins": "select * from (select a, b, n_common, round(r, 6) + 0.0::double as r, verdict from verdict where n_common >= 8 and verdict = 'twin' order by round(r, 6) desc, a, b limit 15) union all select * from (select a, b, n_common, round(r, 6) + 0.0::double as r, verdict from verdict where n_common >= 8 and verdict = 'mirror' order by round(r, 6), a, b limit 10)",
    "top_friends": "select src, dst, n_films, cast(place as integer) as place from (select src, dst, n_films, row_number() over (partition by src order by n_films desc nulls last, dst) as place from (select distinct src, dst, n_films from follows)) where place <= 5",
    "friends_kept_stats": "select median(n) as median, min(n) as least, max(n) as most from (select src, count(*) as n from follows where n_films >= 40 group by src)",
    "film_idf": "select film, round(idf, 6) as idf from idfs",
    "pearson_pairs": f"select a, b, count(*) as n_common, round({PEARSON}, 6) + 0.0::double as r from (select l.user_id as a, q.user_id as b, l.rating as x, q.rating as y from ratings l join ratings q using (film) where l.user_id < q.user_id) group by a, b having count(*) >= 8",
    "rmse_mae": "select model, count(*) as n, round(sqrt(avg((pred - actual) * (pred - actual))), 6) as rmse, round(avg(abs(pred - actual)), 6) as mae from preds group by model",
    "threshold_metrics": """
        select model, n, round(coalesce(pos / nullif(n, 0), 0), 6) as base, round(coalesce(ok / nullif(n, 0), 0), 6) as accuracy, round(pr, 6) as precision, round(rc, 6) as recall, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 6) as f1 from (
            select *, coalesce(tp / nullif(tp + fp, 0), 0) as pr, coalesce(tp / nullif(tp + fn, 0), 0) as rc from (
                select model, count(*) as n, count(*) filter (actual >= 4) as pos, count(*) filter (pred >= 4 and actual >= 4) as tp, count(*) filter (pred >= 4 and actual < 4) as fp, count(*) filter (pred < 4 and actual >= 4) as fn, count(*) filter ((pred >= 4) = (actual >= 4)) as ok from preds group by model))""",
    "precision_at_k": "select model, round(count(*) filter (actual >= 4) / count(*), 6) as precision_at_k from (select * from preds qualify row_number() over (partition by model order by round(pred, 9) desc, user_id, film) <= 10) group by model",
    "precision_at_5_fixed": "select model, user_id, round(count(*) filter (actual >= 4) / 5, 6) as precision_at_k from (select * from preds qualify row_number() over (partition by model, user_id order by round(pred, 9) desc, film) <= 5) group by model, user_id",
    "auc": _ranked("(select model, round(pred, 9) as p9, actual from preds)", "model", "p9", "actual >= 4"),
    "per_user_auc": _ranked("(select model, user_id, round(pred, 9) as p9, actual from preds)", "model, user_id", "p9", "actual >= 4"),
    "fisher_exact": f"""
        select arm, a, b, c, d, round(least(1.0, sum(case when q <= seen + 1e-12 then q else 0 end)), 6) as p from (
            select *, {_LN_P} as q, {_LN_P.replace("(i +", "(a +").replace("- i +", "- a +").replace("+ i +", "+ a +")} as seen from (
                select *, unnest(range(cast(greatest(0, a - d) as bigint), cast(least(a + b, a + c) + 1 as bigint))) as i from (
                    select arm, s.twins as a, s.n - s.twins as b, z.twins as c, z.n - z.twins as d from summary s, (select twins, n from summary where arm = 'none') z where arm <> 'none'
                    union all values ('known 1', 6, 71, 5, 72), ('known 2', 20, 57, 5, 72)))) group by arm, a, b, c, d""",
    "ece": "select model, round(sum(n * abs(mp - my)) / sum(n), 6) as ece from (select model, least(9, floor(p * 10)) as bin, count(*) as n, avg(p) as mp, avg(label) as my from naive group by all) group by model",
    "calibration_metrics": _calibration("naive"),
    "naive_calibration": "select user_id, film, label, model, round(p, 6) as p from naive",
    "recent_split": "select user_id, film, is_test from split",
    "global_temporal_split": "select user_id, film, row_number() over (order by ts, user_id, film) > floor(0.9::double * count(*) over ()) as is_test from ratings",
    "per_user_holdout": "select user_id, film, row_number() over (partition by user_id order by draw, film) <= 10 and count(*) over (partition by user_id) >= 25 as is_test from drawn",
    "random_split": "select user_id, film, case when place <= floor(0.9::double * n) then 'train' else 'test' end as part from placed",
    "three_way_split": "select user_id, film, part from parts",
    "leave_one_out_random": "select user_id, film, row_number() over (partition by user_id order by draw, film) = 1 as is_test from drawn",
    "control_sample": "select user_id, score from candidates where n_seeds = 1 order by md5(concat_ws(':', user_id, '7')), user_id limit 30",
    "ranked_candidates": "select * from candidates order by n_seeds desc, score desc, user_id limit 30",
    "most_popular": "select film, lb_total from cat order by lb_total desc, film limit 8",
    "pages_to_enumerate": "select film, cast(sum(ceil(n / 25.0)) as bigint) as pages from hist where stars >= 4.5 group by film",
    "crowd_fallback_join": "select user_id, film, round(coalesce(lb_avg, 3.0), 6) as pred from ratings left join crowd using (film)",
    "baseline_ladder": "select model, user_id, film, round(pred, 6) as pred, actual from base",
    "neighbour_cf": "select user_id, film, round(pred, 6) as pred, actual from cf",
    "cf_blend": "select user_id, film, round(greatest(0.5, least(5.0, 0.5 * b.pred + 0.5 * raw)), 6) as pred, cf.actual from cf join (select user_id, film, pred from base where model = 'user + crowd') b using (user_id, film)",
    "cf_coverage": "select user_id, n_test, coalesce(covered, 0) as covered, round(coalesce(covered / nullif(n_test, 0), 0), 6) as coverage from (select user_id, count(*) as n_test from split where is_test group by user_id) left join (select user_id, count(*) as covered from cf group by user_id) using (user_id)",
    "bias_predictions": "select user_id, film, part, round(score, 6) as score, label from scored",
    "calibration_sweep": "select cast(size as integer) as size, count(*) as n, round(avg(score), 6) as mean_score, round(avg(label), 6) as like_rate from (select *, row_number() over (order by draw, user_id, film) as place from scored where part = 'cal'), (select unnest([50, 100, 200, 500, 1000, 5000]) as size) where place <= size group by size",
    "calibration_fits": _SWEEP,
    "platt_calibration": _fitted("platt"),
    "isotonic_calibration": _fitted("isotonic"),
    "sha_shard": "select page_id, cast(list_reduce(list_prepend(0, list_transform(string_split(sha256(url), ''), lambda c: cast(strpos('0123456789abcdef', c) - 1 as bigint))), lambda a, d: (a * 16 + d) % 7) as integer) as shard from pages",
    "host_eta": "select round(max(n) * 4.5::double, 6) as seconds from (select count(*) as n from hosted group by host)",
    "set_ops": """
        select op, count(*) as n, cast(sum(user_id) as bigint) as ids from (
            select 'both' as op, user_id from (select user_id from events where event_type = 'purchase' intersect select user_id from events where event_type = 'signup')
            union all select 'either', user_id from (select user_id from events where event_type = 'purchase' union select user_id from events where event_type = 'signup')
            union all select 'first only', user_id from (select user_id from events where event_type = 'purchase' except select user_id from events where event_type = 'signup')) group by op""",
    "temperature_scaling": _calibration(_TEMPERATURE),
    "page_addresses": """
        select user_id, film, unnest(['feed', 'films', 'following', 'followers', 'film', 'reviews', 'histogram', 'friends', 'rated', 'members', 'likes']) as kind,
            'https://s.example' || unnest([u || '/rss/', u || '/films/' || pg, u || '/following/' || pg, u || '/followers/' || pg, f || '/', f || '/reviews/by/activity/', '/csi' || f || '/rating-histogram/', u || '/friends' || f || '/',
                f || '/members/rated/' || case when rating >= 1 then cast(cast(floor(rating) as integer) as varchar) else '' end || case when rating % 1 <> 0 then '%C2%BD' else '' end || '/' || pg, f || '/members/' || pg, f || '/likes/' || pg]) as url
        from (select user_id, film, rating, '/' || user_id as u, '/film/' || film as f, case when film % 3 = 0 then '' else 'page/' || (film % 3 + 1) || '/' end as pg from ratings)""",
    "missing_fields": """
        select field, best, best < 0.5 as missing from (select unnest(['film', 'rating', 'liked_true']) as field, unnest([max(f), max(r), max(l)]) as best from (
            select round(count(film) / count(*), 3) as f, round(count(rating) / count(*), 3) as r, round(count(*) filter (liked) / count(*), 3) as l from feed group by user_id))""",
    "films_by_cost": "select film, pages_ge4, coalesce(rating, -1.0) as rating from cat left join (select film, rating from ratings where user_id = (select min(user_id) from ratings)) using (film)",
    "first_common": """
        select a, b, string_agg(cast(film as varchar), ',' order by film) as common from (
            select l.user_id as a, r.user_id as b, film, row_number() over (partition by l.user_id, r.user_id order by film) as n from ratings l join ratings r using (film)
            where l.user_id = (select min(user_id) from ratings) and r.user_id <> l.user_id) where n <= 20 group by a, b""",
    "poster_lookup": "select film, coalesce(poster, '') as poster from cat left join (select page_id as film, min(url) as poster from pages group by page_id) using (film)",
    "seed_ranking": "select * from agree order by n_shared desc, agree_rate desc, abs(mean_gap), user_id limit 30",
    "frame_sample": "select user_id from (select distinct user_id from ratings where rating >= 4 and film in (select film from cat order by lb_total desc, film limit 20)) order by md5(concat_ws(':', user_id, '7')), user_id limit 50",
}


def oracle_sql() -> dict[str, str]:
    return {name: SHARED + text for name, text in STATEMENTS.items()}
