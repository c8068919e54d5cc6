"""Every operator as a query over the test tables, with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import exports as X
from ..operators import gst as G
from ..operators import merge as M
from ..operators import prepaid as P
from ..operators import receipts as R
from ..operators import subscriptions as U
from ..sources import documents as D
from ..streaming import changes as C
from ..streaming import uploads as T
from . import adapter as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
WANTED = R.ReceiptFilter(from_date="Jan 1, 1996", to_date="1998/12/31", categories=("1-URGENT", " 2-HIGH "), vendor="customer#0000000")
_WANTED_SQL = "day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND category IN ('1-URGENT', '2-HIGH') AND contains(lower(vendor), 'customer#0000000')"
_LABEL = "CASE WHEN day IS NULL THEN purchase_date ELSE strftime(day, '%B %-d, %Y') END"
_CENTS = "CAST(floor(({0} + 2.220446049250313e-16) * 100 + 0.5) AS BIGINT)"


def query(sql: str | None = None, base: bool = True):
    """Registers a query, and its SQL behind the common table expressions (unless not ``base``)."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {A.SQL}, {sql.removeprefix('WITH ')}" if base and sql.startswith("WITH ") else f"WITH {A.SQL} {sql}" if base else sql
        return f

    return register


@query(f"SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, CAST(sum({_CENTS.format('total')}) AS BIGINT) AS total_cents, CAST(sum(lines) AS BIGINT) AS n_items FROM r JOIN d USING (k) LEFT JOIN (SELECT k, count(*) AS lines FROM i GROUP BY k) USING (k) WHERE day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND category IN ('1-URGENT', '2-HIGH') GROUP BY day")
def spending_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of a range and two categories by day: number, total, items."""
    wanted = R.ReceiptFilter("1996-01-01", "1998-12-31", ("1-URGENT", "2-HIGH"))
    rows = R.filter_receipts(A.receipts(spark, sf_dir), wanted)
    lines = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")).join(rows.select("key"), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("lines"))
    day = S.date_text(S.purchase_date(F.col("purchase_date")))
    return rows.join(lines, "key", "left").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(S.cents(F.col("total"))).alias("total_cents"), F.sum("lines").alias("n_items"))


@query("SELECT id, coalesce(CAST(day AS VARCHAR), '') AS day FROM r JOIN d USING (k)")
def date_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.receipts(spark, sf_dir).select("id", S.date_text(S.purchase_date(F.col("purchase_date"))).alias("day"))


@query(f"SELECT id, {_LABEL} AS label FROM r JOIN d USING (k)")
def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.receipts(spark, sf_dir).select("id", S.date_label(F.col("purchase_date")).alias("label"))


@query(
    "SELECT id, CASE WHEN k % 8 = 7 THEN strftime(o_orderdate, '%Y.%m.%d') ELSE strftime(o_orderdate + CASE WHEN k % 8 IN (1, 6) THEN INTERVAL 1 DAY WHEN k % 8 = 5 THEN INTERVAL (-1) DAY ELSE INTERVAL 0 DAY END, '%B %-d, %Y') END AS label FROM r"
)
def free_form_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as mail headers, clocks and people write them; some of their zones lie a day ahead or behind."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    forms = ("EEE, dd MMM yyyy' 10:00:00 +0200'", "EEE MMM dd yyyy' 23:30:00 GMT-0200 (Some Time)'", "d MMMM yyyy", "MMM d yyyy' 3:04 PM'", "M/d/yyyy', 12:15:00 AM'", "yyyy-MM-dd'T01:00:00+05:30'", "MMMM d, yyyy' 11:00 pm EST'", "yyyy.MM.dd")
    text = F.coalesce(*(F.when(k % 8 == i, F.date_format(day, form)) for i, form in enumerate(forms)))
    return A.table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), k).alias("id"), S.date_label(text).alias("label"))


@query(f"SELECT id, vendor, category FROM r JOIN d USING (k) WHERE {_WANTED_SQL}")
def filter_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filter_receipts(A.receipts(spark, sf_dir), WANTED).select("id", "vendor", "category")


@query("SELECT count(*) AS n FROM r JOIN d USING (k) WHERE day >= DATE '1997-01-01'")
def matching_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bound that can't be read asks for nothing."""
    return R.filter_receipts(A.receipts(spark, sf_dir), R.ReceiptFilter("1997-01-01", "no date")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_LABEL} AS label, count(*) AS n, CAST(sum({_CENTS.format('total')}) AS BIGINT) AS total_cents, min(k) AS first_ord FROM r JOIN d USING (k) GROUP BY 1")
def receipts_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.group_by_date(A.receipts(spark, sf_dir))


@query(f"SELECT {_LABEL} AS label, count(*) AS n, CAST(sum({_CENTS.format('total')}) AS BIGINT) AS total_cents, min(k) AS first_ord FROM r JOIN d USING (k) WHERE {_WANTED_SQL} GROUP BY 1")
def filtered_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.group_by_date(R.filter_receipts(A.receipts(spark, sf_dir), WANTED))


@query(f"SELECT count(*) AS n, CAST(sum({_CENTS.format('total')}) AS BIGINT) AS total_cents FROM r")
def receipt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.totals(A.receipts(spark, sf_dir))


@query(f"SELECT id, vendor, {_LABEL.replace('%B', '%b')} AS date, CAST({_CENTS.format('total')} // 100 AS VARCHAR) || '.' || lpad(CAST({_CENTS.format('total')} % 100 AS VARCHAR), 2, '0') AS total FROM r JOIN d USING (k)")
def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.display_rows(A.receipts(spark, sf_dir))


@query(
    "SELECT id, CASE WHEN k % 100 = 1 AND k % 7 = 0 THEN 'again ' || vendor ELSE vendor END AS vendor, CASE WHEN k % 14 = 0 THEN 'from detail' WHEN k % 7 = 0 AND k % 100 <> 1 THEN '' ELSE category END AS category, "
    "'s' || CASE WHEN k % 100 = 1 AND k % 7 = 0 THEN k // 100 + 1 ELSE k // 100 END AS shard_doc_id, CASE WHEN k % 14 = 0 THEN 'text' ELSE '' END AS extracted_text, total FROM r"
)
def receipts_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards, details and duplicates resolved."""
    rows = R.all_receipts(D.owner_shards(A.shards(spark, sf_dir), A.OWNER), A.details(spark, sf_dir))
    return rows.select("id", "vendor", "category", "shard_doc_id", "extracted_text", "total")


@query("SELECT id, CASE WHEN k % 7 = 0 THEN '' ELSE category END AS category, 's' || k // 100 AS shard_doc_id FROM r UNION ALL SELECT id, category, 's' || (k // 100 + 1) FROM r WHERE k % 100 = 1")
def shard_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.expand_shards(A.shards(spark, sf_dir)).select("id", "category", "shard_doc_id")


@query("SELECT id, vendor, CASE WHEN k % 14 = 0 THEN 'from detail' WHEN k % 7 = 0 THEN '' ELSE category END AS category FROM r WHERE k = 700")
def receipt_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first shard with the id counts, whether complete or not."""
    return R.find_receipt(A.shards(spark, sf_dir), A.details(spark, sf_dir), "r700").select("id", "vendor", "category")


@query("WITH k AS (SELECT DISTINCT sh FROM (SELECT k // 100 AS sh FROM r UNION ALL SELECT k // 100 + 1 FROM r WHERE k % 100 = 1)) SELECT 's' || sh AS id, row_number() OVER (ORDER BY sh DESC) AS page FROM k")
def shard_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.shard_pages(A.shards(spark, sf_dir)).select("id", F.col("page").cast("long").alias("page"))


@query("SELECT id, CASE WHEN n > 1 THEN base || ' (' || n || ').jpg' ELSE base || '.jpg' END AS name FROM (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY k) AS n FROM (SELECT id, k, coalesce(CAST(day AS VARCHAR), 'unknown-date') || ' - ' || vendor AS base FROM r JOIN d USING (k)))")
def filename_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.image_names(A.receipts(spark, sf_dir)).select("id", "name")


_PRICE = "CAST(" + _CENTS.format("price") + " // 100 AS VARCHAR) || '.' || lpad(CAST(" + _CENTS.format("price") + " % 100 AS VARCHAR), 2, '0')"
_ITEMS = f"it AS (SELECT k, string_agg(name || ' x' || CAST(CAST(quantity AS BIGINT) AS VARCHAR) || ' ($' || {_PRICE} || ')', '; ' ORDER BY pos) AS items FROM i GROUP BY k)"


@query(f"WITH {_ITEMS} SELECT id, coalesce(items, '') AS items FROM r LEFT JOIN it USING (k)")
def item_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.receipts(spark, sf_dir, True).select("id", X.items_text(F.col("items")).alias("items"))


@query(
    f"WITH {_ITEMS} SELECT k AS ord, '\"' || coalesce(CAST(day AS VARCHAR), '') || '\",\"INV-' || k || '\",\"' || replace(vendor, '\"', '\"\"') || '\",\"' || coalesce(items, '') || '\",\"' || "
    "CASE WHEN tax % 100 = 0 THEN CAST(tax // 100 AS VARCHAR) ELSE rtrim(CAST(tax // 100 AS VARCHAR) || '.' || lpad(CAST(tax % 100 AS VARCHAR), 2, '0'), '0') END || '\"' AS line FROM r JOIN d USING (k) JOIN t USING (k) LEFT JOIN it USING (k)"
)
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.receipt_lines(A.receipts(spark, sf_dir, True))


_DESCRIBED = (
    "g AS (SELECT k, lower(trim(name)) AS key, arg_min(name, pos) AS name, CAST(sum(quantity) AS BIGINT) AS q, min(pos) AS pos FROM {0} GROUP BY k, lower(trim(name))), "
    "dx AS (SELECT k, string_agg(q || ' × ' || name, '; ' ORDER BY pos) AS description FROM g GROUP BY k)"
)


@query(f"WITH {_DESCRIBED.format('i')} SELECT id, coalesce(description, '') AS description FROM r LEFT JOIN dx USING (k)")
def gst_item_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.receipts(spark, sf_dir, True)
    return rows.select("id", G.describe_items(G.bought_items(F.coalesce("items", F.array().cast(rows.schema["items"].dataType)))).alias("description"))


@query(f"SELECT id, ({_CENTS.format('total')} * 1300 + 5000) // 10000 AS tax_cents FROM r")
def gst_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.receipts(spark, sf_dir).select("id", S.tax_cents(S.cents(F.col("total"))).alias("tax_cents"))


_MATCH = (
    "nl AS (SELECT k, count(*) AS n FROM i GROUP BY k), full_ AS (SELECT k FROM t WHERE tax > 0 AND (subtotal * 1300 + 5000) // 10000 = tax), "
    "m AS (SELECT k, unnest(range(1, 1 << CAST(n AS INTEGER))) AS m FROM nl JOIN t USING (k) WHERE tax > 0 AND k NOT IN (SELECT k FROM full_)), "
    "sm AS (SELECT m.k, m.m, sum(cents) AS total FROM m JOIN i ON i.k = m.k AND (m.m >> CAST(i.pos AS INTEGER)) & 1 = 1 GROUP BY m.k, m.m), "
    "ok AS (SELECT sm.k, count(*) AS n, min(m) AS m FROM sm JOIN t ON t.k = sm.k WHERE (total * 1300 + 5000) // 10000 = tax GROUP BY sm.k), "
    "part_ AS (SELECT i.* FROM i JOIN full_ USING (k) UNION ALL SELECT i.* FROM i JOIN ok ON ok.k = i.k AND ok.n = 1 AND (ok.m >> CAST(i.pos AS INTEGER)) & 1 = 1), "
    + _DESCRIBED.format("part_")
    + ", st AS (SELECT r.k, id, tax, vendor, CASE WHEN full_.k IS NOT NULL OR ok.n = 1 THEN 'matched' WHEN ok.n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status, coalesce(description, '') AS description FROM r JOIN t USING (k) LEFT JOIN full_ ON full_.k = r.k LEFT JOIN ok ON ok.k = r.k LEFT JOIN dx ON dx.k = r.k)"
)
_TEXT = "CAST(tax // 100 AS VARCHAR) || '.' || lpad(CAST(tax % 100 AS VARCHAR), 2, '0')"


@query(f"WITH {_MATCH} SELECT id, status, description FROM st")
def gst_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.infer(A.receipts(spark, sf_dir, True)).select("id", F.col("match_status").alias("status"), "description")


@query(f"WITH {_MATCH} SELECT coalesce(CAST(day AS VARCHAR), '') AS date, 'INV-' || k AS invoice_id, vendor AS supplier, description, {_TEXT} AS tax, tax AS tax_cents, id AS receipt_id, status FROM st JOIN d USING (k) WHERE tax > 0 AND day BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def gst_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rebate_rows(A.receipts(spark, sf_dir, True), "1996-01-01", "June 30, 1997")


@query(f"WITH {_MATCH} SELECT count(*) AS total, count_if(status = 'matched') AS matched, count_if(status = 'ambiguous') AS ambiguous, count_if(status = 'unmatched') AS unmatched FROM st WHERE tax > 0")
def gst_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.summary(G.rebate_rows(A.receipts(spark, sf_dir, True)))


def _few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form's worth of receipts: the form holds 30 rows and refuses more, so its query names the receipts it is for."""
    return G.form_rows(G.rebate_rows(A.receipts(spark, sf_dir, True).where("key < 25"), None, None))


_FORM = f"WITH {_MATCH}, fr AS (SELECT *, row_number() OVER (ORDER BY day IS NULL, day, id) AS row_number FROM st JOIN d USING (k) WHERE tax > 0 AND k < 25)"


@query(f"{_FORM} SELECT id AS receipt_id, CAST(row_number AS INTEGER) AS row_number, CASE WHEN row_number <= 11 THEN 1 ELSE 2 END AS page, CAST(CASE WHEN row_number <= 11 THEN row_number ELSE row_number - 11 END AS INTEGER) AS slot FROM fr")
def form_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _few(spark, sf_dir).select("receipt_id", "row_number", "page", "slot")


@query(f"{_FORM} SELECT p.page, CAST(coalesce(sum(tax), 0) AS BIGINT) AS total_cents, CAST(CAST(coalesce(sum(tax), 0) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(coalesce(sum(tax), 0) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS total FROM (VALUES (1), (2)) p(page) LEFT JOIN fr ON (row_number <= 11) = (p.page = 1) GROUP BY p.page")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.page_totals(_few(spark, sf_dir))


@query(f"WITH {_MATCH} SELECT '\"' || coalesce(CAST(day AS VARCHAR), '') || '\",\"INV-' || k || '\",\"' || vendor || '\",\"' || replace(description, '\"', '\"\"') || '\",\"' || {_TEXT} || '\"' AS line FROM st JOIN d USING (k) WHERE tax > 0")
def rebate_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.rebate_lines(G.rebate_rows(A.receipts(spark, sf_dir, True))).select("line")


@query("SELECT id, CASE WHEN k % 10 = 0 THEN 'new ' || vendor ELSE vendor END AS vendor, CASE WHEN k % 10 = 0 THEN 0 ELSE 1 END AS part FROM r UNION ALL SELECT 'n' || k, 'new ' || vendor, 0 FROM r WHERE k % 100 = 0")
def upsert_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.receipts(spark, sf_dir).select("id", "ord", "vendor", "key")
    new = rows.where("key % 10 = 0").withColumn("vendor", F.concat(F.lit("new "), F.col("vendor")))
    other = new.where("key % 100 = 0").withColumn("id", F.concat(F.lit("n"), F.col("key")))
    return M.upsert_receipts(rows, new.unionByName(other)).select("id", "vendor", F.col("rank.part").alias("part"))


@query("SELECT id, category FROM r WHERE k % 3 <> 0")
def remove_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.receipts(spark, sf_dir)
    return M.remove_by_id(rows, rows.where("key % 3 = 0")).select("id", "category")


@query("SELECT r.id, coalesce(e.c, r.category) AS category FROM r LEFT JOIN (SELECT 'r' || user_id AS id, arg_max(event_type, (ts, event_id)) AS c FROM events GROUP BY user_id) e ON e.id = r.id")
def category_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.table(spark, sf_dir, "events")
    changes = events.select(F.concat(F.lit("r"), F.col("user_id")).alias("receipt_id"), F.col("event_type").alias("category"), F.struct("ts", "event_id").alias("ts"))
    return C.apply_category_changes(A.receipts(spark, sf_dir), changes).select("id", "category")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), (ts, event_id)) AS k FROM events GROUP BY user_id", base=False)
def events_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = C.latest_by_key(A.table(spark, sf_dir, "events"))
    return last.select("user_id", "event_id", "event_type", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2", base=False)
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.windowed_counts(A.table(spark, sf_dir, "events"))


@query("SELECT 'p' || k AS id, CASE WHEN k % 3 = 0 OR vendor = '' THEN 'Retailer' ELSE vendor END AS retailer, CASE WHEN k % 3 = 0 THEN '1999-01-01' ELSE purchase_date END AS shown_date FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) JOIN r USING (k)")
def purchase_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_sales_receipts(A.purchases(spark, sf_dir), A.receipts(spark, sf_dir)).select("id", "retailer", "shown_date")


_CARDS = "pc AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_returnflag) AS n, lpad(CAST(l_partkey % 10000 AS VARCHAR), 4, '0') AS last4, l_returnflag = 'R' AS archived, l_linenumber, l_partkey, l_extendedprice FROM lineitem)"


@query(f"WITH {_CARDS} SELECT 'p' || k AS purchase_id, 'c' || n AS card_id, CASE WHEN archived THEN 'archived' ELSE 'active' END AS state, CASE WHEN k % 3 = 0 THEN 'Retailer unavailable' ELSE vendor END AS retailer, CAST(k % 3 + 1 AS INTEGER) AS activation_receipt_count FROM pc JOIN r USING (k) WHERE last4 = '0042'")
def search_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search, its results opened from the lists, with their retailers."""
    purchases = A.purchases(spark, sf_dir)
    results = P.search_cards(purchases, "00-42")
    opened = P.open_results(results, purchases)
    return P.results_with_receipts(opened, A.receipts(spark, sf_dir)).select("purchase_id", "card_id", "state", "retailer", "activation_receipt_count")


@query(f"WITH {_CARDS} SELECT 'p' || k AS id, CAST(count_if(NOT archived) AS INTEGER) AS active_card_count, CAST(count_if(archived) AS INTEGER) AS archived_card_count, CAST(k % 3 + 1 AS INTEGER) AS activation_receipt_count FROM pc GROUP BY k")
def card_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.card_counts(A.purchases(spark, sf_dir))


@query(f"WITH {_CARDS} SELECT 'p' || k AS id, count(*) AS n FROM pc WHERE NOT archived GROUP BY k")
def active_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_state(A.purchases(spark, sf_dir), "active").select("id", F.size("cards").cast("long").alias("n"))


@query(
    f"WITH {_CARDS}, pp AS (SELECT k, count_if(archived AND l_linenumber % 2 = 0) AS p, count_if(archived AND l_linenumber % 3 = 0) AS o, CASE WHEN bool_and(archived) THEN k % 3 + 1 ELSE 0 END AS a, bool_or(archived) AS s FROM pc GROUP BY k) "
    "SELECT CAST(sum(p) AS BIGINT) AS package_images_deleted, CAST(sum(o) AS BIGINT) AS opened_card_images_deleted, CAST(sum(a) AS BIGINT) AS activation_receipt_images_deleted, count_if(s) AS sales_receipts_preserved FROM pp"
)
def cleanup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cleanup_counts(A.purchases(spark, sf_dir))


@query(f"WITH {_CARDS} SELECT 'p' || k AS purchase_id, 'c' || n AS card_id, '•••• ' || last4 AS masked, '...' || right(lpad(CAST(l_partkey * 7919 + k * 104729 + 1 AS VARCHAR), 30, '0'), 12) AS barcode, l_extendedprice AS denomination, 'package-card-' || last4 || '.jpg' AS package_image_name, 'opened-card-' || last4 || '.jpg' AS opened_image_name FROM pc")
def card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.card_rows(A.purchases(spark, sf_dir))


@query("SELECT 'p' || k AS purchase_id, 'a' || n AS receipt_id, CAST(n AS INTEGER) AS ordinal FROM (SELECT k, unnest(range(1, k % 3 + 2)) AS n FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem))", base=False)
def activation_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.activation_ordinals(A.purchases(spark, sf_dir))


@query("SELECT name, arg_max(description, place) AS description FROM (SELECT p_partkey AS place, p_brand AS name, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS description FROM part) GROUP BY name", base=False)
def category_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category maps of many documents; a later document's description of a name wins."""
    parts = A.table(spark, sf_dir, "part")
    maps = parts.select(F.col("p_partkey").alias("place"), F.create_map(F.concat(F.lit("  "), F.col("p_brand"), F.lit("\t")), F.when(F.col("p_size") % 5 != 0, F.col("p_type")), F.lit("  "), F.lit("blank name")).alias("categories"))
    return M.flatten_categories(maps)


@query("SELECT p_brand AS name FROM part UNION SELECT o_orderpriority FROM orders UNION SELECT c_mktsegment FROM customer", base=False)
def category_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n, c: A.table(spark, sf_dir, n).select(c)
    return R.category_options(t("part", "p_brand"), t("orders", "o_orderpriority"), t("customer", "c_mktsegment"))


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("Free", "Plus yearly", "PRO", "Other"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return A.table(spark, sf_dir, "part").select(F.concat(F.lit("plan"), F.col("p_partkey")).alias("id"), name.alias("name"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("a"))).alias("features"), F.lit(None).cast("string").alias("interval"), F.col("p_partkey").alias("payment_plan_id"), F.col("p_size").cast("long").alias("price_cents"), F.lit(None).cast("long").alias("monthly_limit"))


@query("SELECT 'plan' || p_partkey AS id, CASE p_partkey % 4 WHEN 1 THEN 'Plus yearly' ELSE 'PRO' END AS name, 'month' AS interval, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS n_features, '0.' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS price FROM part WHERE p_partkey % 4 IN (1, 2)", base=False)
def visible_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = U.visible_plans(D.read_plans(_plans(spark, sf_dir)), "plus")
    return plans.select("id", "name", "interval", F.size("features").alias("n_features"), U.price_text(F.col("price_cents")).alias("price"))


@query("SELECT c_custkey AS uid, CASE WHEN c_custkey % 3 = 0 THEN 'free' WHEN c_custkey % 3 = 1 THEN 'Pro' ELSE c_mktsegment END AS plan_name, CASE WHEN c_custkey % 3 = 1 THEN 2 ELSE 0 END AS tier, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS monthly_limit, c_custkey % 5 = 0 AS payment_method_saved FROM customer", base=False)
def plan_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored plan documents projected, with their tiers."""
    k = F.col("c_custkey")
    data = F.to_json(F.struct(F.when(k % 3 == 1, "  Pro yearly ").alias("plan_name"), F.when(k % 3 == 2, F.col("c_mktsegment")).alias("plan_id"), F.when(k % 2 == 0, k).alias("monthly_limit"), (k % 5 == 0).alias("payment_method_ready")))
    plans = A.table(spark, sf_dir, "customer").select(k.alias("uid"), U.project_plan(F.parse_json(data)).alias("p"))
    return U.with_tier(plans.select("uid", "p.plan_name", "p.monthly_limit", "p.payment_method_saved")).select("uid", "plan_name", "tier", "monthly_limit", "payment_method_saved")


@query("SELECT count(*) AS documents, count_if(contains(lower(text), 'the')) AS found, CAST(sum(length(regexp_replace(text, '[^0-9]', '', 'g'))) AS BIGINT) AS digits FROM documents", base=False)
def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted text: how many documents hold a word in any case, and how many digits there are."""
    text = F.col("text")
    return A.table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.lower(text).contains("the")).alias("found"), F.sum(F.char_length(S.digits(text))).alias("digits"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_extendedprice AS VARCHAR) AS text, l_extendedprice AS value, CAST(floor(l_extendedprice + 0.0) AS BIGINT) AS lead FROM lineitem", base=False)
def number_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written, read again, and read as the start of a text."""
    text = F.format_string("%.2f", "l_extendedprice")
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_extendedprice", text.alias("t"))
    shown = S.plain_number(F.col("l_extendedprice"))
    return rows.select("k", "n", F.when(shown.contains("."), shown).otherwise(F.concat(shown, F.lit(".0"))).alias("text"), S.number(F.concat(F.lit(" "), F.col("t"), F.lit("\n"))).alias("value"), F.floor(S.leading_number(F.concat(F.col("t"), F.lit("kg")))).alias("lead"))


@query("SELECT c_custkey AS k, regexp_replace(trim(regexp_replace(regexp_replace(' ' || c_name || CASE WHEN c_custkey % 3 = 0 THEN '/x:  ?' ELSE '. ' END || c_mktsegment || ' . ', '[<>:\"/\\\\|?*]', '-', 'g'), '\\s+', ' ', 'g')), '[. ]+$', '') AS name FROM customer", base=False)
def filename_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, "/x:  ?").otherwise(". "), F.col("c_mktsegment"), F.lit(" . "))
    return A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), S.filename_part(raw, "none").alias("name"))


@query("SELECT p_partkey AS id, CASE WHEN p_size > 20 THEN 20 ELSE p_size END AS width, CAST(greatest(1, floor(37 * least(1.0, 20.0 / p_size) + 0.5)) AS BIGINT) AS height FROM part", base=False)
def image_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import images as I

    fit = I.fit_width(F.col("p_size").cast("double"), F.lit(37.0), 20)
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), fit.alias("f")).select("id", "f.width", "f.height")


@query(
    "WITH c AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x0, CAST(p_partkey % 40 AS DOUBLE) AS y0, CAST(60 + p_size AS DOUBLE) AS x1, CAST(50 + p_partkey % 50 AS DOUBLE) AS y1 FROM part), "
    "p AS (SELECT *, greatest(0, floor(x0 - (x1 - x0) * 0.04)) AS l, greatest(0, floor(y0 - (y1 - y0) * 0.04)) AS t, least(120, ceil(x1 + (x1 - x0) * 0.04)) AS r, least(100, ceil(y1 + (y1 - y0) * 0.04)) AS b FROM c), "
    "g AS (SELECT id, CASE WHEN x0 / 120 <= 0.06 THEN 0 ELSE l END AS l, CASE WHEN y0 / 100 <= 0.06 THEN 0 ELSE t END AS t, CASE WHEN (120 - x1) / 120 <= 0.06 THEN 120 ELSE r END AS r, CASE WHEN (100 - y1) / 100 <= 0.06 THEN 100 ELSE b END AS b FROM p WHERE NOT (r - l >= 120 AND b - t >= 100)) "
    "SELECT id, CAST(l AS BIGINT) AS left_, CAST(t AS BIGINT) AS top_, CAST(r AS BIGINT) AS right_, CAST(b AS BIGINT) AS bottom_ FROM g WHERE NOT (r - l >= 120 AND b - t >= 100)",
    base=False,
)
def crop_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guarded crop of upright corners on a 120x100 image; whole frames have none."""
    from ..operators import images as I

    x0, y0, x1, y1 = (c.cast("double") for c in (F.col("p_size"), F.col("p_partkey") % 40, F.col("p_size") + 60, F.col("p_partkey") % 50 + 50))
    corner = lambda x, y, n: F.struct(x.alias("x"), y.alias("y")).alias(n)
    corners = F.struct(corner(x0, y0, "tl"), corner(x1, y0, "tr"), corner(x1, y1, "br"), corner(x0, y1, "bl"))
    crop = I.guarded_rectangle(corners, F.lit(120.0), F.lit(100.0))
    rows = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), crop.alias("c")).where("c is not null")
    return rows.select("id", *(F.col(f"c.{n}").alias(f"{n}_") for n in ("left", "top", "right", "bottom")))


@query("SELECT c_custkey AS k, 'Archived photo cleanup complete: ' || (c_custkey % 4) || ' package, ' || (c_custkey % 3) || ' opened-card, and ' || (c_custkey % 2) || ' activation receipt image' || CASE WHEN c_custkey % 2 = 1 THEN '' ELSE 's' END || ' deleted. ' || (c_custkey % 5) || ' sales receipt' || CASE WHEN c_custkey % 5 = 1 THEN '' ELSE 's' END || ' preserved.' || CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN ' 1 image could not be deleted.' ELSE ' ' || (c_custkey % 7) || ' images could not be deleted.' END AS text FROM customer", base=False)
def cleanup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return A.table(spark, sf_dir, "customer").select(k.alias("k"), S.cleanup_text(k % 4, k % 3, k % 2, k % 5, F.when(k % 7 > 0, k % 7)).alias("text"))


@query("SELECT p_partkey AS place, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END + CASE WHEN p_brand = 'Brand#1' THEN 0 ELSE 1 END AS n, p_type AS kept, CAST(NULL AS VARCHAR) AS renamed FROM part", base=False)
def category_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map with an entry put, one renamed without a description, one deleted."""
    parts = A.table(spark, sf_dir, "part")
    base = F.map_filter(F.create_map(F.col("p_brand"), F.col("p_type"), F.lit("old"), F.lit("text"), F.concat(F.lit("even"), F.col("p_size") % 2), F.lit("x")), lambda k, v: k != "even1")
    edited = M.put_category(M.put_category(M.drop_category(base, "Brand#1"), "Brand#1", "", "old"), "Brand#1", " ")
    return parts.select(F.col("p_partkey").alias("place"), F.size(edited).alias("n"), F.col("p_type").alias("kept"), F.try_element_at(edited, F.lit("Brand#1")).alias("renamed"))


@query("SELECT id, CAST(greatest(n, 0) + 1 AS INTEGER) AS n, CASE WHEN n > 0 THEN 'edited' ELSE 'New item' END AS first, 'New item' AS last FROM (SELECT id, coalesce(c, 0) AS n FROM r LEFT JOIN (SELECT k, count(*) AS c FROM i GROUP BY k) USING (k))")
def item_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new item at the end, the first one edited where there was one."""
    items = F.coalesce("items", F.array().cast("array<struct<name:string,quantity:double,price:double>>"))
    edited = F.when(F.size(items) > 0, M.replace_item(M.add_item(items), 0, " edited ", 2, 3)).otherwise(M.add_item(items))
    return A.receipts(spark, sf_dir, True).select("id", edited.alias("e")).select("id", F.size("e").alias("n"), F.get("e", F.lit(0))["name"].alias("first"), F.element_at("e", -1)["name"].alias("last"))


@query("SELECT c_custkey AS k, c_name AS email, c_custkey + 10 AS expires FROM customer", base=False)
def token_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("c_name").alias("email"), (F.col("c_custkey") + 10).alias("exp")))
    token = F.concat(F.lit("h."), F.rtrim(F.translate(F.base64(body.cast("binary")), "+/=", "-_ ")), F.lit(".s"))
    rows = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), D.token_payload(token, "email string, exp long").alias("p"))
    return rows.select("k", "p.email", F.col("p.exp").alias("expires"))


@query("SELECT id, vendor, CASE WHEN k % 5 = 0 THEN 'INV-' || k || ' edited' ELSE 'INV-' || k END AS invoice_id, CASE WHEN k % 5 = 0 THEN 12.0 ELSE total END AS total FROM r")
def receipt_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of two fields by id; of two edits of a receipt the later one counts."""
    rows = A.receipts(spark, sf_dir)
    edits = rows.where("key % 5 = 0").select("id", F.lit(2).alias("ord"), F.concat("invoice_id", F.lit(" edited")).alias("invoice_id"), M.edit_value("total", "12abc")["total"].alias("total"))
    older = edits.withColumns({"ord": F.lit(1), "total": F.lit(1.0)})
    return M.update_by_id(rows, edits.unionByName(older)).select("id", "vendor", "invoice_id", "total")


@query("SELECT id, vendor, category FROM r WHERE k = 3", base=True)
def receipt_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt that isn't among the visible ones, from all of them."""
    rows = A.receipts(spark, sf_dir).select("id", "vendor", "category", "key")
    return R.select_by_id(rows.where("key > 100"), rows, "r3").select("id", "vendor", "category")


@query("SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN length(CAST(l_partkey AS VARCHAR)) IN (4) THEN 'ok' ELSE 'no' END AS valid FROM lineitem", base=False)
def draft_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of cards: valid where the barcode has its 30 digits, which only four-digit parts fill here."""
    code = F.concat(F.lit("12-34 " * 6 + "56"), F.col("l_partkey").cast("string"))
    draft = F.array(F.struct(F.lit("f").alias("storage_path"), code.alias("activation_barcode"), F.lit("2" * 11).alias("vanilla_serial"), F.lit(" 50 ").alias("denomination")), F.struct(*(F.lit("").alias(n) for n in ("storage_path", "activation_barcode", "vanilla_serial", "denomination"))))
    return A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.when(P.drafts_valid(draft), "ok").otherwise("no").alias("valid"))


@query(
    "WITH x AS (SELECT p_partkey AS id, 10 + p_size % 20 AS x0 FROM part) SELECT id, 80 AS width, 60 AS height, CAST(floor(x0 - (59 - x0) * 0.04) AS BIGINT) AS left_, 10 AS top_, CAST(ceil(59 + (59 - x0) * 0.04) AS BIGINT) AS right_, 49 AS bottom_ FROM x",
    base=False,
)
def auto_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper on a dark ground, drawn from the parts table's sizes, found and cut out."""
    from ..operators import images as I

    found = I.auto_crop(A.drawn(A.table(spark, sf_dir, "part")))
    return found.select("id", "width", "height", *(F.col(f"crop.{n}").alias(f"{n}_") for n in ("left", "top", "right", "bottom")))


@query("SELECT 'd' || p_partkey // 2 AS id, arg_max(p_type, (p_partkey % 2, p_partkey)) AS description FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1", base=False)
def owner_category_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category documents under an address as typed and in lower case; of both copies of an id the one in lower case counts."""
    k = F.col("p_partkey")
    email = F.when(k % 7 == 0, "ME@X.ORG").when(k % 2 == 0, "Me@x.org").otherwise("me@x.org")
    docs = A.table(spark, sf_dir, "part").select(F.concat(F.lit("d"), F.floor(k / 2)).alias("id"), k.alias("ord"), email.alias("owner_email"), F.create_map("p_brand", "p_type").alias("categories"))
    return D.owner_categories(docs, " Me@x.org ").select("id", F.get(F.map_values("categories"), F.lit(0)).alias("description"))


@query("SELECT 'Plus' AS plan_name, c_custkey AS monthly_limit, 'u3' AS owner_email FROM customer WHERE c_custkey % 10 = 3 ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 1", base=False)
def user_plan_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of a user who isn't known by id, but by address."""
    k = F.col("c_custkey")
    email = F.concat(F.lit("u"), k % 10)
    users = A.table(spark, sf_dir, "customer").select(k.cast("string").alias("uid"), email.alias("owner_email"), F.to_json(F.struct(F.lit("Plus yearly").alias("plan_name"), k.alias("monthly_limit"), email.alias("owner_email"))).alias("data"))
    return U.user_plan(users, "nobody", "u3").select("plan_name", "monthly_limit", "owner_email")


@query(f"WITH {_CARDS} SELECT last4, CASE WHEN archived THEN 'archived' ELSE 'active' END AS state, l_extendedprice AS denomination FROM pc WHERE n = 1 AND k = 1")
def card_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.card_detail(A.purchases(spark, sf_dir), "p1", "c1").select("card.last4", "card.state", "card.denomination")


@query("SELECT o_orderkey AS k, 2 AS n_items, CAST(o_orderkey % 10 AS DOUBLE) AS quantity, CAST(0 AS DOUBLE) AS price, '' AS second_name, CAST(2 AS DOUBLE) AS second_quantity, 1 AS n_fields, 'v' || o_orderkey AS value FROM orders", base=False)
def detail_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and extracted fields of stored details, with what can't be read among them."""
    k = F.col("o_orderkey")
    items = F.concat(F.lit('{"items":[{"name":"a","quantity":"'), k % 10, F.lit('","price":"x"},7,{"name":1,"quantity":2}],'))
    data = F.concat(items, F.lit('"extracted_fields":[{"label":"l","value":"v'), k, F.lit('"},{"label":"l"},{"label":1,"value":"v"},"t"]}'))
    rows = A.table(spark, sf_dir, "orders").select(k.alias("k"), F.parse_json(data).alias("d")).select("k", D.items_of(F.col("d")).alias("i"), D.fields_of(F.col("d")).alias("f"))
    first, second = (F.get("i", F.lit(n)) for n in (0, 1))
    return rows.select("k", F.size("i").alias("n_items"), first["quantity"].alias("quantity"), first["price"].alias("price"), second["name"].alias("second_name"), second["quantity"].alias("second_quantity"), F.size("f").alias("n_fields"), F.get("f", F.lit(0))["value"].alias("value"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey AS VARCHAR) || '56' END AS barcode, CASE WHEN p_partkey % 3 = 1 THEN CAST(p_size AS DOUBLE) END AS denomination FROM part", base=False)
def draft_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of drafts: empty ones are left out, digits are kept, an amount that can't be read is none."""
    k = F.col("p_partkey")
    text = lambda c: F.when(k % 3 > 0, c).otherwise("")
    draft = F.struct(F.lit("").alias("storage_path"), text(F.concat(k.cast("string"), F.lit("-5 6"))).alias("activation_barcode"), F.lit("").alias("vanilla_serial"), text(F.when(k % 3 == 1, F.concat(F.lit(" "), F.col("p_size"))).otherwise("none")).alias("denomination"))
    rows = A.table(spark, sf_dir, "part").select(k.alias("id"), P.draft_cards(F.array(draft)).alias("cards"))
    one = F.get("cards", F.lit(0))
    return rows.select("id", F.size("cards").alias("n"), one["activation_barcode"].alias("barcode"), one["denomination"].alias("denomination"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 AND p_size % 2 = 0 THEN 'read' ELSE 'typed' END AS activation_barcode, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '5' END AS denomination FROM part", base=False)
def extraction_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted values over those of drafts: an empty text leaves the draft's, a number replaces it."""
    parts = A.table(spark, sf_dir, "part")
    drafts = parts.select(F.col("p_partkey").alias("id"), F.lit("typed").alias("activation_barcode"), F.lit("s").alias("vanilla_serial"), F.lit("5").alias("denomination"))
    new = parts.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "read").otherwise("").alias("activation_barcode"), F.lit(None).cast("string").alias("serial_number"), F.col("p_size").cast("double").alias("denomination"))
    return P.overlay_extraction(drafts, new).select("id", "activation_barcode", "denomination")


@query(
    f"WITH {_CARDS}, c AS (SELECT k, count(*) AS n FROM pc GROUP BY k), ch AS (SELECT min(k) AS low FROM c WHERE k % 5 = 0), al AS (SELECT min(k) AS low FROM c) "
    "SELECT 'p' || k AS id, CASE WHEN k % 5 = 0 THEN 'new' WHEN k % 3 = 0 THEN 'x' || k ELSE 'r' || k END AS sales_receipt_id, n, k AS ord FROM c UNION ALL SELECT 'n' || k, 'new', n, al.low - 1 - (k - ch.low) FROM c, ch, al WHERE k % 50 = 0"
)
def purchase_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed purchases in their places, several new ones in front, the last of them first."""
    purchases = A.purchases(spark, sf_dir)
    changed = purchases.where("ord % 5 = 0").withColumn("sales_receipt_id", F.lit("new"))
    new = changed.where("ord % 50 = 0").withColumn("id", F.concat(F.lit("n"), F.col("ord")))
    return P.upsert_purchase(purchases, changed.unionByName(new)).select("id", "sales_receipt_id", F.size("cards").cast("long").alias("n"), "ord")


def category_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of a category, twice, and of a text for every seventh order."""
    key = F.col("o_orderkey")
    edit = lambda field, value, ord_: F.struct(F.lit(field).alias("field"), F.lit(value).alias("value"), F.lit(ord_).alias("ord"))
    edits = F.array(edit("category", '"older"', 1), edit("category", '"edited"', 2), edit("extracted_text", '"seen"', 1))
    rows = A.table(spark, sf_dir, "orders").where(key % 7 == 0).select(F.concat(F.lit("s"), F.floor(key / A.SHARD)).alias("shard_doc_id"), F.concat(F.lit("r"), key).alias("receipt_id"), F.explode(edits).alias("e"))
    return rows.select("shard_doc_id", "receipt_id", "e.*")


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return M.write_edits(A.shards(spark, sf_dir), A.details(spark, sf_dir), category_edits(spark, sf_dir))


@query("SELECT id, vendor, CASE WHEN k % 7 = 0 THEN 'edited' ELSE category END AS category, 's' || k // 100 AS shard_doc_id, total FROM r")
def edited_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts after edits that were written to details and to the shards' metadata: the metadata is complete now and counts."""
    shards, details = _edited(spark, sf_dir)
    return R.all_receipts(shards, details).select("id", "vendor", "category", "shard_doc_id", "total")


@query("SELECT 's' || k // 100 AS shard_doc_id, id AS receipt_id, CASE WHEN k % 14 = 0 THEN 'detail vendor' END AS vendor, 'edited' AS category, 'seen' AS extracted_text FROM r WHERE k % 7 = 0")
def edited_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _edited(spark, sf_dir)[1]
    return rows.select("shard_doc_id", "receipt_id", *(F.get_json_object("data", f"$.{n}").alias(n) for n in ("vendor", "category", "extracted_text")))


@query("SELECT id, CASE WHEN k % 3 = 0 THEN 'new/' || k ELSE 'old' END AS image_url, CASE WHEN k % 6 = 0 THEN false ELSE true END AS image_grayscale FROM r")
def image_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New images for every third receipt; half of them say that they aren't gray, the others say nothing."""
    rows = A.receipts(spark, sf_dir).select("id", "key", F.lit("old").alias("image_url"), F.lit(True).alias("image_grayscale"))
    changes = rows.where("key % 3 = 0").select("id", F.lit(1).alias("ord"), F.concat(F.lit("new/"), F.col("key")).alias("storage_path"), F.when(F.col("key") % 2 == 0, False).alias("image_grayscale"))
    return M.replace_images(rows, changes).select("id", "image_url", "image_grayscale")


@query(
    "WITH e AS (SELECT user_id, event_id, ['started', 'stored', 'finalized', 'failed', 'removed'][event_id % 5 + 1] AS kind, CASE WHEN event_id % 2 = 0 THEN 201 ELSE 500 END AS code FROM events), "
    "l AS (SELECT user_id, arg_max(kind, event_id) AS kind, arg_max(code, event_id) AS code, max(event_id) AS last, min(event_id) AS first FROM e GROUP BY user_id) "
    "SELECT CASE WHEN kind = 'finalized' THEN 'r' || last ELSE 'u' || user_id END AS id, CASE WHEN kind = 'finalized' THEN 'success' WHEN kind = 'failed' OR kind = 'stored' AND code = 500 THEN 'error' ELSE 'uploading' END AS status, "
    "CASE WHEN kind = 'failed' THEN 'no network' WHEN kind = 'stored' AND code = 500 THEN 'Upload failed' END AS error_message, first AS ord FROM l WHERE kind <> 'removed'",
    base=False,
)
def upload_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the steps of uploads, a user's as those of one: where each upload stands."""
    k = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("started", "stored", "finalized", "failed", "removed"))), (k % 5 + 1).cast("int"))
    steps = A.table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("upload_id"), k.alias("ord"), kind.alias("kind"), F.when(k % 2 == 0, 201).otherwise(500).alias("code"), F.to_json(F.struct(F.concat(F.lit("r"), k).alias("id"))).alias("data"), F.when(k % 5 == 3, "no network").alias("message")
    )
    return T.upload_states(steps).select("id", "status", "error_message", "ord")


@query("WITH n AS (SELECT max(sh) AS sh FROM (SELECT k // 100 AS sh FROM r UNION ALL SELECT k // 100 + 1 FROM r WHERE k % 100 = 1)) SELECT id, CASE WHEN k // 100 = n.sh OR k % 100 = 1 AND k // 100 + 1 = n.sh THEN 0 ELSE 1 END AS part FROM r, n")
def latest_shard_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list after the newest shard was read again: its receipts first."""
    rows = A.receipts(spark, sf_dir).select("id", F.struct(F.col("key").alias("shard_ord"), F.lit(0).alias("pos")).alias("ord"), F.lit("success").alias("status"))
    return C.refresh_latest(rows, A.shards(spark, sf_dir))[0].select("id", F.col("rank.part").alias("part"))
