"""Queries over the test tables, each with SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import dedup, health, merge, quality, ranking, search, stats
from .operators.search import SearchRequest
from .plans.listings import LISTINGS_SQL, RUNS_SQL, listings, scraper_runs, table
from .registry import ORACLES, QUERIES, query  # noqa: F401
from .sources import bank_csv, html_items
from .streaming import search_log

L, R = LISTINGS_SQL, RUNS_SQL
_PAGE = ["id", "title", "category", "state", "city", "first_auction_value", "is_active"]
_PAGE_SQL = ", ".join(_PAGE)


# --- search ---


@query(f"SELECT {_PAGE_SQL} FROM listings WHERE is_active AND NOT is_duplicate AND lower(category) = 'building' AND contains(lower(city), 'a') AND first_auction_value >= 50000 ORDER BY first_auction_value DESC NULLS LAST, id LIMIT 50 OFFSET 50", L)
def search_rest(spark, sf_dir):
    r = SearchRequest(category="BUILDING", city="a", min_value=50000, sort_by="first_auction_value", page=2, size=50)
    return search.search(listings(spark, sf_dir), r).select(*_PAGE)


@query(f"SELECT {_PAGE_SQL} FROM listings WHERE is_active AND NOT is_duplicate AND (first_auction_value >= 20000 OR second_auction_value >= 20000) AND (first_auction_value <= 90000 OR second_auction_value <= 90000) AND contains(lower(neighborhood), 'zone 1')", L)
def search_either_value(spark, sf_dir):
    r = SearchRequest(min_value=20000, max_value=90000, value_on="either", neighborhood="Zone 1")
    return search.matching(listings(spark, sf_dir), r).select(*_PAGE)


@query(f"SELECT {_PAGE_SQL} FROM listings WHERE is_active AND NOT is_duplicate AND second_auction_value >= 100 AND (contains(lower(title), 'customer#') OR contains(lower(city), 'customer#')) AND discount_percentage > 0 AND discount_percentage <= 100 AND discount_percentage >= 3 ORDER BY discount_percentage DESC NULLS LAST, id LIMIT 20", L)
def search_by_discount(spark, sf_dir):
    r = SearchRequest(min_value=100, value_on="second", text="Customer#", min_discount=3, sort_by="discount_percentage", size=20)
    return search.search(listings(spark, sf_dir), r).select(*_PAGE)


@query(f"SELECT {_PAGE_SQL} FROM listings WHERE source = 'caixa' AND auction_type = '1-URGENT' ORDER BY evaluation_value ASC NULLS FIRST, id LIMIT 30", L)
def search_ascending(spark, sf_dir):
    r = SearchRequest(source="caixa", auction_type="1-URGENT", active_only=False, duplicates=True, sort_by="evaluation_value", descending=False, size=30)
    return search.search(listings(spark, sf_dir), r).select(*_PAGE)


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 18.0) AS BIGINT) AS pages FROM listings WHERE is_active AND NOT is_duplicate", L)
def search_pages(spark, sf_dir):
    return search.page_info(listings(spark, sf_dir, values=False), SearchRequest())


@query("SELECT id, title, category, city, state, latitude, longitude FROM listings WHERE is_active AND NOT is_duplicate AND latitude <> 0 AND longitude <> 0 ORDER BY id LIMIT 1000", L)
def map_search(spark, sf_dir):
    return search.on_map(listings(spark, sf_dir, values=False))


@query("SELECT count(*) AS n, min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east, (min(latitude) + max(latitude)) / 2 AS center_lat, (min(longitude) + max(longitude)) / 2 AS center_lon FROM listings WHERE is_active AND latitude <> 0 AND longitude <> 0", L)
def map_bounds(spark, sf_dir):
    return search.map_bounds(listings(spark, sf_dir, values=False))


@query("SELECT id, state FROM listings WHERE (latitude IS NULL OR latitude = 0 OR longitude IS NULL OR longitude = 0) AND state <> 'XX' AND is_active ORDER BY created_at DESC NULLS LAST, id LIMIT 50", L)
def pending_geocode(spark, sf_dir):
    return search.pending_geocode(listings(spark, sf_dir, values=False)).select("id", "state")


@query("SELECT state, count(*) AS n FROM listings WHERE is_active AND trim(state) <> '' GROUP BY 1", L)
def facet_states(spark, sf_dir):
    return search.facet(listings(spark, sf_dir, values=False), "state")


@query("SELECT state, city, count(*) AS n FROM listings WHERE is_active GROUP BY 1, 2", L)
def facet_cities(spark, sf_dir):
    return search.facet(listings(spark, sf_dir, values=False), "state", "city")


@query("SELECT city, neighborhood, count(*) AS n FROM listings WHERE is_active AND neighborhood IS NOT NULL GROUP BY 1, 2", L)
def facet_neighborhoods(spark, sf_dir):
    return search.facet(listings(spark, sf_dir, values=False), "city", "neighborhood")


# --- statistics ---


@query("""SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_duplicate) AS unique_rows, count(*) FILTER (is_duplicate) AS duplicates,
  count(DISTINCT auctioneer_id) AS auctioneers, CAST(round(sum(d) / count(d), 2) AS DOUBLE) AS mean_discount, max(updated_at) AS last_update
FROM (SELECT *, nullif(round(CAST(discount_percentage AS DECIMAL(18,6)), 4), 0) AS d FROM listings)""", L)
def stats_overview(spark, sf_dir):
    return stats.overview(listings(spark, sf_dir))


@query("SELECT category, count(*) AS n FROM listings GROUP BY 1 ORDER BY n DESC, category LIMIT 10", L)
def count_by_category(spark, sf_dir):
    return stats.count_by(listings(spark, sf_dir, values=False), "category", most=10)


@query("""SELECT dimension, value, count(*) AS n FROM (
  SELECT 'category' AS dimension, category AS value FROM listings UNION ALL SELECT 'state', state FROM listings UNION ALL SELECT 'auction_type', auction_type FROM listings)
WHERE value IS NOT NULL GROUP BY 1, 2""", L)
def stats_by_dimension(spark, sf_dir):
    return stats.count_by_each(listings(spark, sf_dir, values=False), ["category", "state", "auction_type"])


@query("""SELECT is_bank, dimension, value, count(*) AS n FROM (
  SELECT source = 'caixa' AS is_bank, 'state' AS dimension, state AS value FROM listings UNION ALL SELECT source = 'caixa', 'category', category FROM listings
  UNION ALL SELECT source = 'caixa', 'auctioneer_id', CAST(auctioneer_id AS VARCHAR) FROM listings) WHERE value IS NOT NULL GROUP BY 1, 2, 3""", L)
def stats_by_source(spark, sf_dir):
    return stats.by_source(listings(spark, sf_dir), ["state", "category", "auctioneer_id"])


@query("SELECT state, count(*) AS n, CAST(round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS DOUBLE) AS share FROM listings GROUP BY state", L)
def share_of_total(spark, sf_dir):
    return stats.share_of_total(listings(spark, sf_dir, values=False), "state")


_FIELDS_SQL = {f: f"count({f})" for f in stats.FIELDS}


@query("SELECT count(*) AS total, " + ", ".join(f"{s} AS n_{f}, CAST(round({s} * 100.0 / count(*), 1) AS DOUBLE) AS pct_{f}" for f, s in _FIELDS_SQL.items()) + " FROM listings", L)
def quality_report(spark, sf_dir):
    return stats.quality_report(listings(spark, sf_dir))


@query("SELECT *, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'poor' END AS band FROM (SELECT category, count(*) AS n, CAST(round((" + " + ".join(_FIELDS_SQL.values()) + ") * 100.0 / (count(*) * 5), 2) AS DOUBLE) AS score FROM listings GROUP BY 1)", L)
def completeness_score(spark, sf_dir):
    return stats.completeness(listings(spark, sf_dir), "category")


@query("""SELECT count(*) FILTER (city IS NULL OR trim(city) = '') AS no_city, count(*) FILTER (state IS NULL) AS no_state, count(*) FILTER (neighborhood IS NULL) AS no_neighborhood,
  count(*) FILTER (coalesce(first_auction_value, 0) <= 0 AND coalesce(second_auction_value, 0) <= 0) AS no_value, count(*) FILTER (source_url IS NULL) AS no_url,
  count(*) FILTER (discount_percentage < 0 OR discount_percentage > 100) AS bad_discount, count(*) FILTER (second_auction_value > coalesce(first_auction_value, 0)) AS second_above_first,
  count(*) FILTER (first_auction_value > evaluation_value) AS first_above_evaluation FROM listings""", L)
def audit_counts(spark, sf_dir):
    return stats.audit_counts(listings(spark, sf_dir))


@query("""SELECT lower(w) AS folded, string_agg(DISTINCT w, '|' ORDER BY w) AS variants, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)
WHERE w IS NOT NULL GROUP BY 1 HAVING count(DISTINCT w) > 1""")
def case_variants(spark, sf_dir):
    words = F.explode(F.split("text", " ", -1)).alias("w")
    return stats.case_variants(table(spark, sf_dir, "documents").select(words), "w")


@query("SELECT 'https://site' || (key % 9) || '.com/lote/' || (key % 500) AS url, count(*) AS n, min(key) AS first_key FROM listings GROUP BY 1 HAVING count(*) > 1", L)
def duplicate_urls(spark, sf_dir):
    return stats.duplicate_urls(listings(spark, sf_dir, values=False))


@query("SELECT auctioneer_id, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at, count(*) FILTER (image_url IS NULL) AS no_image FROM listings WHERE auctioneer_id IS NOT NULL GROUP BY 1", L)
def per_auctioneer(spark, sf_dir):
    return stats.per_auctioneer(listings(spark, sf_dir))


@query("SELECT category, count(*) AS n, count(image_url) AS with_image, CAST(round((count(*) - count(image_url)) * 100.0 / count(*), 1) AS DOUBLE) AS pct_missing FROM listings GROUP BY 1", L)
def image_coverage(spark, sf_dir):
    return stats.image_coverage(listings(spark, sf_dir, values=False), "category")


@query("SELECT count(DISTINCT category) AS distinct_category, count(DISTINCT state) AS distinct_state, count(DISTINCT neighborhood) AS distinct_neighborhood FROM listings", L)
def distinct_counts(spark, sf_dir):
    return stats.distinct_counts(listings(spark, sf_dir, values=False), ["category", "state", "neighborhood"])


@query("SELECT count(*) AS n_rows, count(second_auction_value) AS n_values FROM listings", L)
def count_vs_values(spark, sf_dir):
    return stats.count_vs_values(listings(spark, sf_dir), "second_auction_value")


@query("SELECT count(*) FILTER (d IS NULL) AS missing, count(*) FILTER (d >= 0 AND d <= 100) AS valid, count(*) FILTER (d < 0 OR d > 100) AS invalid, CAST(round(CAST(max(d) AS DECIMAL(18,6)), 2) AS DOUBLE) AS highest FROM (SELECT discount_percentage AS d FROM listings)", L)
def discount_validity(spark, sf_dir):
    return stats.discount_validity(listings(spark, sf_dir))


@query("SELECT CAST(CASE WHEN value >= 200 THEN 4 WHEN value >= 100 THEN 3 WHEN value >= 50 THEN 2 WHEN value >= 10 THEN 1 ELSE 0 END AS INTEGER) AS band, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def price_bands(spark, sf_dir):
    return stats.banded(table(spark, sf_dir, "events"), "value", [10, 50, 100, 200])


@query("SELECT CASE WHEN first_auction_value < second_auction_value THEN 'first_below_second' WHEN evaluation_value < first_auction_value THEN 'evaluation_below_first' ELSE 'ok' END AS anomaly, count(*) AS n FROM listings GROUP BY 1", L)
def value_anomalies(spark, sf_dir):
    return stats.value_anomalies(listings(spark, sf_dir))


@query("""SELECT CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n > 1) AS groups, max(n) AS largest, CAST(sum(n - 1) AS BIGINT) AS extra, CAST(round(sum(n - 1) * 100.0 / sum(n), 2) AS DOUBLE) AS pct_extra
FROM (SELECT title, state, count(*) AS n FROM listings GROUP BY 1, 2)""", L)
def dedup_stats(spark, sf_dir):
    return stats.dedup_stats(listings(spark, sf_dir, values=False), F.concat_ws("|", "title", "state"))


@query("SELECT json_extract_string(props, '$.k') AS value, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_json_keys(spark, sf_dir):
    return stats.json_top(table(spark, sf_dir, "events"), "props", "$.k")


@query("SELECT state, category AS modal, n FROM (SELECT state, category, count(*) AS n, row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, category) AS r FROM listings GROUP BY 1, 2) WHERE r = 1", L)
def modal_category(spark, sf_dir):
    return stats.modal(listings(spark, sf_dir, values=False), "state", "category")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'view') AS views FROM events GROUP BY 1")
def activity_by_day(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") == "view").alias("views"))


# --- ranking ---

_COUNTS = L + ", counts AS (SELECT auctioneer_name, count(*) AS n FROM listings WHERE auctioneer_name IS NOT NULL GROUP BY 1)"


def _auctioneers(spark, sf_dir):
    return stats.count_by(listings(spark, sf_dir), "auctioneer_name")


@query("""SELECT *, pct <= 80 AS in_head FROM (SELECT auctioneer_name, n, row_number() OVER w AS rank, CAST(sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running,
  CAST(round(sum(n) OVER (w ROWS UNBOUNDED PRECEDING) * 100.0 / sum(n) OVER (), 2) AS DOUBLE) AS pct FROM counts WINDOW w AS (ORDER BY n DESC, auctioneer_name))""", _COUNTS)
def ranking_80_20(spark, sf_dir):
    return ranking.cumulative_ranking(_auctioneers(spark, sf_dir), "auctioneer_name")


@query("""SELECT auctioneer_name, n, position, CASE WHEN position <= floor(t * 0.2) THEN 'HIGH' WHEN position <= floor(t * 0.5) THEN 'MEDIUM' ELSE 'LOW' END AS priority
FROM (SELECT auctioneer_name, n, row_number() OVER (ORDER BY n DESC, auctioneer_name) AS position, count(*) OVER () AS t FROM counts)""", _COUNTS)
def priority_bands(spark, sf_dir):
    return ranking.priority_bands(_auctioneers(spark, sf_dir), "auctioneer_name")


_POINTS = {"neighborhood": 2, "image_url": 3, "latitude": 1, "second_auction_value": 2}


@query("""SELECT id, group_key, points, group_size, canonical_id, id = canonical_id AS is_canonical FROM (SELECT id, group_key, points, count(*) OVER (PARTITION BY group_key) AS group_size,
  first_value(id) OVER (PARTITION BY group_key ORDER BY points DESC, created_at, id) AS canonical_id FROM (SELECT *, title || '|' || category AS group_key,
  CASE WHEN neighborhood IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN image_url IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN latitude IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN second_auction_value IS NOT NULL THEN 2 ELSE 0 END AS points FROM listings))""", L)
def canonical_record(spark, sf_dir):
    out = ranking.canonical_records(listings(spark, sf_dir), F.concat_ws("|", "title", "category"), ranking.completeness_points(_POINTS))
    return out.select("id", "group_key", "points", "group_size", "canonical_id", "is_canonical")


# --- health ---


@query("SELECT scraper, day, found, CAST(round((found - failed) * 100.0 / found, 2) AS DOUBLE) AS pct_ok, CAST(round(redirected * 100.0 / found, 2) AS DOUBLE) AS pct_redirected FROM runs", R)
def run_ratios(spark, sf_dir):
    return health.run_ratios(scraper_runs(spark, sf_dir))


_STREAK = "streaks AS (SELECT scraper, count(*) FILTER (good = 0) AS streak, max(start_time) FILTER (ok) AS last_ok FROM (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY scraper ORDER BY day DESC) AS good FROM runs) GROUP BY 1)"
_LAST = "last_runs AS (SELECT *, count(*) OVER (PARTITION BY scraper) AS n FROM (SELECT *, row_number() OVER (PARTITION BY scraper ORDER BY day DESC) AS age FROM runs) WHERE age <= 10)"
_DECLINE = "declines AS (SELECT scraper, max(n) AS runs, CAST(sum(CASE WHEN age <= n // 2 THEN found ELSE 0 END) AS BIGINT) AS new_found, count(*) FILTER (age <= n // 2) AS new_runs, CAST(sum(CASE WHEN age > n // 2 THEN found ELSE 0 END) AS BIGINT) AS old_found, count(*) FILTER (age > n // 2) AS old_runs FROM last_runs GROUP BY 1)"
_REPORT = """report AS (SELECT scraper, runs, streak, pct_good, CASE WHEN streak >= 3 THEN 'FAILING' WHEN pct_good >= 80 THEN 'HEALTHY' WHEN pct_good >= 50 THEN 'DEGRADED' ELSE 'FAILING' END AS status,
  array_to_string(list_slice([x for x in [CASE WHEN failed > 5 THEN 'many failures' END, CASE WHEN redirected * 5 > found THEN 'redirects' END, CASE WHEN declined THEN 'decline' END, CASE WHEN found < 5 * runs THEN 'few found' END] if x IS NOT NULL], 1, 3), ', ') AS issues
  FROM (SELECT s.*, streak, runs >= 4 AND 2 * new_found * old_runs < old_found * new_runs AS declined FROM (SELECT scraper, CAST(round(count(*) FILTER (ok) * 100.0 / count(*), 2) AS DOUBLE) AS pct_good, sum(found) AS found, sum(failed) AS failed, sum(redirected) AS redirected FROM last_runs GROUP BY 1) s
  JOIN streaks USING (scraper) JOIN declines USING (scraper)) JOIN (SELECT scraper, runs FROM declines) USING (scraper))"""
_HEALTH = ", ".join([R, _STREAK, _LAST, _DECLINE, _REPORT])


@query("SELECT * FROM streaks", ", ".join([R, _STREAK]))
def failure_streak(spark, sf_dir):
    return health.failure_streak(scraper_runs(spark, sf_dir))


@query("SELECT *, runs >= 4 AND 2 * new_found * old_runs < old_found * new_runs AS declined FROM declines", ", ".join([R, _LAST, _DECLINE]))
def decline_flag(spark, sf_dir):
    return health.decline(scraper_runs(spark, sf_dir))


@query("SELECT scraper, runs, streak, pct_good, status, issues FROM report", _HEALTH)
def run_health(spark, sf_dir):
    return health.health_report(scraper_runs(spark, sf_dir))


@query("""SELECT count(*) AS scrapers, count(*) FILTER (status = 'HEALTHY') AS healthy, count(*) FILTER (status = 'DEGRADED') AS degraded, count(*) FILTER (status = 'FAILING') AS failing,
  CASE WHEN count(*) FILTER (status = 'FAILING') > 0 THEN 'FAILING' WHEN count(*) FILTER (status = 'DEGRADED') > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS overall FROM report""", _HEALTH)
def system_summary(spark, sf_dir):
    return health.system_summary(health.health_report(scraper_runs(spark, sf_dir)))


@query("""SELECT 'failing' AS rule, 'scraper ' || scraper AS subject FROM report WHERE status = 'FAILING'
UNION ALL SELECT 'idle', 'scraper ' || scraper FROM runs GROUP BY scraper HAVING date_diff('day', max(day), DATE '2024-02-15') > 2
UNION ALL SELECT 'catalog', 'no neighborhood' FROM listings HAVING count(*) FILTER (neighborhood IS NULL) > 100
UNION ALL SELECT 'catalog', 'half unpriced' FROM listings HAVING count(*) FILTER (first_auction_value > 0) * 2 < count(*)
UNION ALL SELECT 'catalog', 'nothing new' FROM listings HAVING count(*) FILTER (created_at >= TIMESTAMP '2024-02-15' - INTERVAL 1 DAY) = 0""", _HEALTH + "," + L)
def alerts(spark, sf_dir):
    return health.alerts(listings(spark, sf_dir), scraper_runs(spark, sf_dir), "2024-02-15")


@query("SELECT scraper, day, found FROM runs WHERE day >= DATE '2024-01-20' - 7", R)
def run_retention(spark, sf_dir):
    return health.retained(scraper_runs(spark, sf_dir), "2024-01-20").select("scraper", "day", "found")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_events(spark, sf_dir):
    return search_log.daily_counts(table(spark, sf_dir, "events")).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("""SELECT user_id, min(ts) AS start_at, max(ts) + INTERVAL 30 MINUTE AS end_at, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def user_sessions(spark, sf_dir):
    out = search_log.sessions(table(spark, sf_dir, "events"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_at", "end_at")})


# --- merges and lifecycle ---


def _halves(spark, sf_dir):
    rows = listings(spark, sf_dir)
    old = rows.where("key % 5 < 3").select("id", "title", "neighborhood", "first_auction_value", "source")
    new = rows.where("key % 5 > 1").select("id", F.upper("title").alias("title"), F.when(F.col("key") % 2 == 0, F.col("neighborhood")).alias("neighborhood"), (F.col("first_auction_value") + F.when(F.col("key") % 4 == 0, 1).otherwise(0)).alias("first_auction_value"), F.lit("leiloeiro").alias("source"))
    return old, new


_HALVES = L + """, o AS (SELECT id, title, neighborhood, first_auction_value, source FROM listings WHERE key % 5 < 3),
n AS (SELECT id, upper(title) AS title, CASE WHEN key % 2 = 0 THEN neighborhood END AS neighborhood, first_auction_value + CASE WHEN key % 4 = 0 THEN 1 ELSE 0 END AS first_auction_value, 'leiloeiro' AS source FROM listings WHERE key % 5 > 1)"""


@query("""SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.title ELSE n.title END AS title, CASE WHEN n.id IS NULL THEN o.neighborhood ELSE n.neighborhood END AS neighborhood,
  CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' WHEN n.title IS DISTINCT FROM o.title OR n.neighborhood IS DISTINCT FROM o.neighborhood THEN 'updated' ELSE 'unchanged' END AS action FROM o FULL JOIN n ON o.id = n.id""", _HALVES)
def upsert_merge(spark, sf_dir):
    return merge.merge(*_halves(spark, sf_dir), "id", {"title": "replace", "neighborhood": "replace"})


@query("""SELECT *, CASE WHEN oid IS NULL THEN 'inserted' WHEN nid IS NULL THEN 'kept' WHEN title IS DISTINCT FROM ot OR neighborhood IS DISTINCT FROM onb OR first_auction_value IS DISTINCT FROM ov THEN 'updated' ELSE 'unchanged' END AS action
FROM (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL THEN o.title ELSE n.title END AS title, coalesce(n.neighborhood, o.neighborhood) AS neighborhood, coalesce(n.first_auction_value, o.first_auction_value) AS first_auction_value,
  CASE WHEN o.id IS NOT NULL AND coalesce(n.first_auction_value, o.first_auction_value) IS DISTINCT FROM o.first_auction_value THEN o.first_auction_value END AS previous_first_auction_value, o.id AS oid, n.id AS nid, o.title AS ot, o.neighborhood AS onb, o.first_auction_value AS ov FROM o FULL JOIN n ON o.id = n.id)""".replace("SELECT *, CASE WHEN oid", "SELECT id, title, neighborhood, first_auction_value, previous_first_auction_value, CASE WHEN oid"), _HALVES)
def upsert_coalesce(spark, sf_dir):
    return merge.merge(*_halves(spark, sf_dir), "id", {"title": "keep", "neighborhood": "coalesce", "first_auction_value": "track"})


@query("""SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL OR (o.source = 'caixa' AND n.source <> 'caixa') THEN o.title ELSE n.title END AS title, CASE WHEN n.id IS NULL OR (o.source = 'caixa' AND n.source <> 'caixa') THEN o.source ELSE n.source END AS source,
  CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' WHEN o.source = 'caixa' AND n.source <> 'caixa' THEN 'protected' WHEN n.title IS DISTINCT FROM o.title OR n.source IS DISTINCT FROM o.source THEN 'updated' ELSE 'unchanged' END AS action FROM o FULL JOIN n ON o.id = n.id""", _HALVES)
def protected_upsert(spark, sf_dir):
    return merge.merge(*_halves(spark, sf_dir), "id", {"title": "replace", "source": "replace"}, (F.col("o.source") == "caixa") & (F.col("n.source") != "caixa"))


@query("""SELECT n.id, coalesce(u.id_by_url, i.id) AS old_id FROM (SELECT * FROM listings WHERE key % 2 = 1) n LEFT JOIN (SELECT key % 9 AS a, key % 500 AS b, min(id) AS id_by_url FROM listings WHERE key % 2 = 0 OR key % 5 = 0 GROUP BY 1, 2) u ON n.key % 9 = u.a AND n.key % 500 = u.b
LEFT JOIN (SELECT id FROM listings WHERE key % 2 = 0 OR key % 5 = 0) i ON n.id = i.id""", L)
def match_by_url_or_id(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return merge.match_by_url_or_id(rows.where("key % 2 = 0 or key % 5 = 0"), rows.where("key % 2 = 1")).select("id", "old_id")


@query("""SELECT id, is_active AND NOT (coalesce(auctioneer_id = 1, FALSE) AND NOT is_duplicate AND NOT EXISTS (SELECT 1 FROM listings s WHERE s.key % 2 = 0 AND s.key % 9 = l.key % 9 AND s.key % 500 = l.key % 500)) AS is_active FROM listings l""", L)
def deactivate_unseen(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return merge.deactivate_unseen(rows, rows.where("key % 2 = 0"), 1).select("id", "is_active")


@query("SELECT id, is_active AND NOT coalesce(updated_at < TIMESTAMP '2001-08-01' - INTERVAL 900 DAY, FALSE) AS is_active FROM listings", L)
def deactivate_stale(spark, sf_dir):
    return merge.deactivate_stale(listings(spark, sf_dir), "2001-08-01", 900).select("id", "is_active")


@query("SELECT id, CASE WHEN is_active AND coalesce(first_auction_value, 0) <= 0 THEN 'no_value' END AS reason, is_active AND coalesce(first_auction_value, 0) > 0 AS is_active FROM listings", L)
def deactivate_bad(spark, sf_dir):
    return merge.deactivate_bad(listings(spark, sf_dir)).select("id", "reason", "is_active")


@query("""SELECT id, coalesce(CASE WHEN x >= 0 AND x <= 100 THEN x END, CASE WHEN evaluation_value > 0 THEN CAST(greatest(round((e - p) * 100 / e, 2), 0) AS DOUBLE) END) AS discount_percentage
FROM (SELECT *, CASE WHEN key % 2 = 0 THEN -1.0 ELSE discount_percentage END AS x, CAST(evaluation_value AS DECIMAL(18,2)) AS e, CAST(coalesce(second_auction_value, first_auction_value) AS DECIMAL(18,2)) AS p FROM listings) WHERE x >= 0 OR p IS NULL OR p > e""", L)
def discount_repair(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("discount_percentage", F.when(F.col("key") % 2 == 0, -1.0).otherwise(F.col("discount_percentage")))
    x, e, p = F.col("discount_percentage"), F.col("evaluation_value").cast("decimal(18,2)"), F.coalesce("second_auction_value", "first_auction_value").cast("decimal(18,2)")
    return merge.repair_discount(rows.where((x >= 0) | p.isNull() | (p > e))).select("id", "discount_percentage")


@query("SELECT s_suppkey AS id, s_name AS name, coalesce(n, 0) AS property_count FROM supplier LEFT JOIN (SELECT auctioneer_id, count(*) AS n FROM listings WHERE is_active AND NOT is_duplicate GROUP BY 1) ON s_suppkey = auctioneer_id", L)
def auctioneer_counts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return merge.auctioneer_counts(listings(spark, sf_dir), s)


@query("""SELECT id, CASE WHEN k IS NULL THEN 'pending' WHEN k % 4 > 1 THEN 'done' WHEN k % 4 = 1 THEN 'invalid' WHEN k % 3 + 1 >= 3 THEN 'failed' ELSE 'pending' END AS geocoding_status, CAST(key % 3 + CASE WHEN k IS NULL THEN 0 ELSE 1 END AS INTEGER) AS geocoding_attempts
FROM (SELECT id, key, CASE WHEN key % 2 = 0 OR key % 3 = 0 THEN key END AS k FROM listings)""", L)
def geocode_transition(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumns({"geocoding_status": F.lit("pending"), "geocoding_attempts": (F.col("key") % 3).cast("int"), "geocoding_error": F.lit(None).cast("string")})
    k = F.col("key")
    tries = rows.where("key % 2 = 0 or key % 3 = 0").select("id", (k % 4 > 1).alias("success"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.when(k % 4 == 1, "invalid address").otherwise("timeout").alias("error"))
    return merge.geocode_transition(rows, tries).select("id", "geocoding_status", "geocoding_attempts")


# --- quality ---

_AUDIT = L + """, a AS (SELECT *, coalesce(second_auction_date < first_auction_date, FALSE) AS sw FROM listings), b AS (SELECT id, evaluation_value, discount_percentage AS d, CASE WHEN sw THEN second_auction_date ELSE first_auction_date END AS d1, sw, CASE WHEN sw THEN second_auction_value ELSE first_auction_value END AS x1, CASE WHEN sw THEN first_auction_value ELSE second_auction_value END AS x2 FROM a),
c AS (SELECT *, coalesce(x2 > x1, FALSE) AS ab, CASE WHEN x2 > x1 THEN x2 ELSE x1 END AS v1, CASE WHEN x2 > x1 THEN x1 ELSE x2 END AS v2 FROM b), e AS (SELECT *, CASE WHEN v1 > 0 AND v2 IS NOT NULL THEN (1 - v2 / v1) * 100 END AS ex FROM c),
audited AS (SELECT id, v1 AS first_auction_value, v2 AS second_auction_value, CASE WHEN coalesce(abs(d - ex) > 1, d IS NULL AND ex IS NOT NULL) THEN ex ELSE d END AS discount_percentage,
  concat_ws(',', CASE WHEN d1 > TIMESTAMP '1999-01-01' + INTERVAL 365 DAY THEN 'date_too_far' END, CASE WHEN d < 0 OR d > 100 THEN 'discount_out_of_range' END) AS errors,
  concat_ws(',', CASE WHEN d1 < TIMESTAMP '1999-01-01' - INTERVAL 30 DAY THEN 'date_past' END, CASE WHEN v1 > evaluation_value THEN 'first_above_evaluation' END) AS warnings,
  concat_ws(',', CASE WHEN sw THEN 'dates_swapped' END, CASE WHEN coalesce(abs(d - ex) > 1, d IS NULL AND ex IS NOT NULL) THEN 'discount_recomputed' END, CASE WHEN ab THEN 'values_swapped' END) AS corrections FROM e)"""


def _audited(spark, sf_dir):
    rows = listings(spark, sf_dir)
    known = [f"NATION_{i}" for i in range(25)]
    return quality.audit(rows, "1999-01-01", known)


@query("SELECT id, first_auction_value, second_auction_value, discount_percentage, errors, warnings, corrections, errors = '' AS passed FROM audited", _AUDIT)
def audit_rows(spark, sf_dir):
    joined = [F.array_join(c, ",").alias(c) for c in ("errors", "warnings", "corrections")]
    return _audited(spark, sf_dir).select("id", "first_auction_value", "second_auction_value", "discount_percentage", *joined, "passed")


@query("""SELECT count(*) AS n, count(*) FILTER (errors = '') AS passed, count(*) FILTER (warnings <> '') AS warned, count(*) FILTER (corrections <> '') AS corrected,
  CAST(round(count(*) FILTER (errors = '') * 100.0 / count(*), 2) AS DOUBLE) AS pct_passed, CAST(round(count(*) FILTER (corrections <> '') * 100.0 / count(*), 2) AS DOUBLE) AS pct_corrected FROM audited""", _AUDIT)
def audit_batch(spark, sf_dir):
    return quality.audit_summary(_audited(spark, sf_dir))


@query("SELECT coalesce(CASE WHEN image_url IS NULL THEN 'no_image' END, 'none') AS failure, count(*) AS n FROM listings GROUP BY 1", L)
def first_failure(spark, sf_dir):
    out = quality.first_failure(listings(spark, sf_dir))
    return out.groupBy(F.coalesce("failure", F.lit("none")).alias("failure")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, concat_ws(',', CASE WHEN neighborhood IS NULL THEN 'neighborhood' END, CASE WHEN latitude IS NULL OR latitude = 0 THEN 'latitude' END, CASE WHEN first_auction_value IS NULL OR first_auction_value = 0 THEN 'first_auction_value' END) AS missing FROM listings", L)
def missing_fields(spark, sf_dir):
    return quality.missing_fields(listings(spark, sf_dir), ["neighborhood", "latitude", "first_auction_value"]).select("id", "missing")


# --- sources and fuzzy duplicates; no SQL says the same ---


_LINE = r"""lines AS (SELECT o_orderkey AS key, CAST(o_orderkey % 90 + 100 AS DOUBLE) * 1000 + 0.5 AS price, CAST(o_orderkey % 900 + 100 AS DOUBLE) * 1000 AS appraisal, ['SP', 'PR', 'XX', 'MG'][o_orderkey % 4 + 1] AS uf,
  ['Sao Paulo', 'Embu das Artes'][o_orderkey % 2 + 1] AS city, ['Apartamento', 'Casa', 'Terreno', 'Outro'][o_orderkey % 4 + 1] AS category FROM orders WHERE o_orderkey % 10 > 0)"""


@query("SELECT 'caixa-' || key AS id, category, CASE WHEN uf = 'XX' THEN 'XX' ELSE uf END AS state, city, price AS first_auction_value, appraisal AS evaluation_value, CASE WHEN key % 3 > 0 THEN 12.5 ELSE CAST(greatest(round((CAST(appraisal AS DECIMAL(18,2)) - CAST(price AS DECIMAL(18,2))) * 100 / CAST(appraisal AS DECIMAL(18,2)), 2), 0) AS DOUBLE) END AS discount_percentage FROM lines", _LINE)
def bank_rows(spark, sf_dir):
    """Bank files with titles, headers and empty lines among rows of three separators."""
    k = F.col("o_orderkey")
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), F.pmod(k, F.lit(len(v))).cast("int"))
    fields = [k.cast("string"), pick("SP", "PR", "XX", "MG"), pick("SAO PAULO", "EMBU DAS ARTES"), F.lit("CENTRO"), F.lit("RUA A 1"), F.concat(F.format_string("%d", k % 90 + 100), F.lit(".000,50")), F.concat(F.format_string("%d", k % 900 + 100), F.lit(".000")), F.when(k % 3 > 0, "12.5").otherwise(" "), pick("Apartamento 50 m2", "Casa térrea", "Terreno 9 x 20", "Objeto"), F.lit("Venda Direta"), F.concat(F.lit("https://x.y/d.asp?hdnimovel="), k)]
    comma = [F.replace(f, F.lit(","), F.lit(".")) for f in fields]
    line = F.when(k % 10 == 0, pick("Lista de imóveis", "", "N° do imóvel;UF;Cidade", " ")).when(k % 3 == 0, F.concat_ws(";", *fields)).otherwise(F.concat_ws("\t", *fields))
    return bank_csv.to_listings(bank_csv.split_lines(table(spark, sf_dir, "orders").select(line.alias("line")))).select("id", "category", "state", "city", "first_auction_value", "evaluation_value", "discount_percentage")


_CLEAN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&#36;', '$'), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query("SELECT page_id, " + _CLEAN.format("nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '')") + """ AS title, nullif(trim(regexp_extract(html, '(?is)<meta[^>]+name=["'']description["''][^>]+content=["'']([^"'']*)', 1)), '') AS description,
  len(regexp_extract_all(html, '(?i)<a\\s')) AS links, len(regexp_extract_all(html, '(?i)<img\\s')) AS images, len(regexp_extract_all(html, '(?i)<p[\\s>]')) AS paragraphs, """ + _CLEAN.format("regexp_replace(html, '(?is)(<script\\b.*?</script>)|(<style\\b.*?</style>)', ' ', 'g')") + """ AS text,
  md5(array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?i)<([a-z0-9]+(?:[^>]*?class=["''][^"'']*)?)', 1))), ',')) AS signature FROM pages""")
def html_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_items.page_fields(F.col("html")).alias("p"), html_items.structure_signature(F.col("html")).alias("signature")).select("page_id", "p.*", "signature")


@query("""SELECT DISTINCT url, CASE WHEN regexp_matches(h, '(?i)^[a-z]+:') THEN h ELSE regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || h END AS link FROM (SELECT url, unnest(regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"''#]+)', 1)) AS h FROM pages)""")
def html_links(spark, sf_dir):
    return html_items.links(table(spark, sf_dir, "pages"))


@query()
def dedup_blocked_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return dedup.blocked_pairs(rows, ["p_brand", "p_type"], "name", "p_partkey")


@query("SELECT id, upper(state) || '_' || substr(regexp_replace(lower(city), '[^a-z]', '', 'g'), 1, 20) || '_customer' AS k, lower(trim(title)) || '|' || lower(city) || '|' || lower(state) AS plain FROM listings", L)
def dedup_keys(spark, sf_dir):
    rows = listings(spark, sf_dir, values=False)
    c = {n: F.col(n) for n in ("title", "city", "state")}
    return rows.select("id", dedup.words_key(c["title"], c["city"], c["state"]).alias("k"), dedup.plain_key(c["title"], c["city"], c["state"]).alias("plain"))


from . import queries_fields, queries_more, queries_sources  # noqa: E402, F401  they register theirs
