"""Named queries over the test tables, each with an equivalent statement for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import categorize as C
from ..operators import detect as D
from ..operators import recurring as R
from ..operators import transfers as X
from ..operators.order_stats import with_expanding_median
from ..schema import BANK_HINTS, DOMAIN_ALIASES, KEYWORD_RULES, MERCHANT_RULES, MERCHANTS, PERIODS, PLACES
from ..scratch import written
from .. import service as S
from . import views

FLAGSHIP = "d10_rule_score"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
VIEWS = {"ord": views.orders, "ev": views.events, "plant": views.planted, "mv": views.moved}


def query(name: str, view: str | None = None, sql: str | None = None):
    """Register f(ledger) over a view, or f(spark, sf_dir), and the statement for DuckDB."""

    def add(f):
        _QUERIES[name] = f if view is None else lambda spark, sf_dir: f(VIEWS[view](spark, sf_dir))
        if sql is not None:
            _SQL[name] = f"WITH {views.SQL}{sql}"
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r(column, digits: int = 4):
    return F.round(column, digits)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ROW = "account_id, merchant_norm"

# scans, filters, parsing

query("s8_date_parse", "ord", "SELECT txn_id, try_strptime(strftime(posted_date, '%-m/%-d/%Y'), '%m/%d/%Y')::DATE AS us, try_strptime(strftime(posted_date, '%d/%m/%Y'), '%d/%m/%Y')::DATE AS eu, try_strptime('x' || posted_date, '%Y-%m-%d')::DATE AS bad FROM ord")(
    lambda l: l.select("txn_id", T.parse_date(F.date_format("posted_date", "M/d/yyyy"), "M/d/yyyy").alias("us"), T.parse_date(F.date_format("posted_date", "dd/MM/yyyy"), "d/M/yyyy").alias("eu"), T.parse_date(F.concat(F.lit("x"), F.col("posted_date").cast("string")), "yyyy-M-d").alias("bad"))
)
query("s9_amount_parse", "ord", "SELECT txn_id, try_cast(try_cast(regexp_replace(trim(' $1,' || lpad(CAST(txn_id % 1000 AS VARCHAR), 3, '0') || '.50 '), '[,$]', '', 'g') AS DECIMAL(12,2)) AS DOUBLE) AS parsed, try_cast('(4.75)' AS DOUBLE) AS bad FROM ord")(
    lambda l: l.select("txn_id", T.parse_amount(F.concat(F.lit(" $1,"), F.lpad((F.col("txn_id") % 1000).cast("string"), 3, "0"), F.lit(".50 "))).cast("double").alias("parsed"), T.parse_amount(F.lit("(4.75)")).cast("double").alias("bad"))
)
query("s15_scan_filter", "ord", "SELECT txn_id, posted_date, amount FROM ord WHERE account_id = 7 AND amount < -100000")(
    lambda l: l.where("account_id = 7 AND amount < -100000").select("txn_id", "posted_date", "amount")
)

# text and features

_CLEAN = "upper(raw_description)"
for _p, _to in T.CLEANING:
    _CLEAN = f"regexp_replace({_CLEAN}, {q(_p)}, {q(_to)}, 'g')"
_CLEAN = f"regexp_replace(array_to_string(list_filter(string_split_regex({_CLEAN}, '\\s+'), lambda w: w <> '' AND NOT list_contains({views._list(PLACES)}, w)), ' '), '[\\s*./]+$', '', 'g')"
_DOMAIN = "CASE " + " ".join(f"WHEN contains(upper(raw_description), {q(k)}) THEN {q(v)}" for k, v in DOMAIN_ALIASES.items()) + " END"
_KEYWORD = "CASE " + " ".join(f"WHEN contains(upper(raw_description), {q(k)}) THEN {q(v)}" for k, v in KEYWORD_RULES.items()) + " END"
_SUBSET = "CASE " + " ".join(
    f"WHEN len(list_intersect(string_split(cleaned, ' '), {(own := views._list(m.upper().split()))})) > 0 AND (list_has_all(string_split(cleaned, ' '), {own}) OR list_has_all({own}, string_split(cleaned, ' '))) THEN {q(m)}" for m in MERCHANTS
) + " END"
_NAMED = f"named AS (SELECT *, coalesce({_DOMAIN}, {_SUBSET}) AS quick FROM (SELECT *, {_CLEAN} AS cleaned FROM ord)), ruled AS (SELECT *, coalesce(CASE {' '.join(f'WHEN quick = {q(k)} THEN {q(v)}' for k, v in MERCHANT_RULES.items())} END, {_KEYWORD}) AS rule_category FROM named)"


def _named(l: DataFrame) -> DataFrame:
    return l.join(C.quick_names(l), "raw_description", "left")


def _ruled(l: DataFrame) -> DataFrame:
    return C.rule_category(_named(l).withColumn("merchant_norm", F.col("quick")))


query("f1_clean", "ord", f"SELECT txn_id, {_CLEAN} AS cleaned FROM ord")(lambda l: l.select("txn_id", T.clean_descriptor(F.col("raw_description")).alias("cleaned")))
query("f2_domain_alias", "ord", f"SELECT txn_id, {_DOMAIN} AS merchant FROM ord")(lambda l: l.select("txn_id", T.domain_alias(F.col("raw_description")).alias("merchant")))
query("f3a_subset_alias", "ord", f", {_NAMED} SELECT txn_id, quick AS merchant FROM named")(lambda l: _named(l).select("txn_id", F.col("quick").alias("merchant")))


def _fuzzy(texts: str) -> str:
    """Tables for DuckDB that end in `fuzzy` (text, name): every text of `texts` scored against every name."""
    masks = "list_transform(string_split(rest, ''), lambda c: CAST(list_sum(list_transform(range(1, len(own_rest) + 1), lambda i: CASE WHEN substr(own_rest, i, 1) = c THEN CAST(1 AS BIGINT) << (i - 1) ELSE CAST(0 AS BIGINT) END)) AS BIGINT))"
    bits = "((CAST(1 AS BIGINT) << CAST(len(own_rest) AS INT)) - 1)"
    lcs = f"CASE WHEN rest = '' OR own_rest = '' THEN 0 ELSE len(own_rest) - bit_count(list_reduce(list_prepend({bits}, {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {bits})) END"
    rest = lambda a, b: f"array_to_string(list_sort(list_filter({a}, lambda w: NOT list_contains({b}, w))), ' ')"
    return f"""fnames AS (SELECT unnest(range({len(MERCHANTS)})) AS no, unnest({views._list(MERCHANTS)}) AS name), ftexts AS (SELECT DISTINCT text, list_sort(list_distinct(list_filter(string_split(text, ' '), lambda w: w <> ''))) AS x FROM ({texts})),
fpairs AS (SELECT *, len(array_to_string(list_filter(x, lambda w: list_contains(y, w)), ' ')) AS shared, {rest('x', 'y')} AS rest, {rest('y', 'x')} AS own_rest FROM ftexts, (SELECT *, list_sort(list_distinct(string_split(upper(name), ' '))) AS y FROM fnames) WHERE len(x) > 0),
fscored AS (SELECT *, shared + (shared > 0)::INT + len(rest) AS fa, shared + (shared > 0)::INT + len(own_rest) AS fb, {lcs} AS lcs FROM fpairs),
fuzzy AS (SELECT text, arg_max(name, (score, -no)) AS name FROM (SELECT *, CASE WHEN shared > 0 AND (rest = '' OR own_rest = '') THEN 100.0::DOUBLE ELSE 100 * greatest(1 - (len(rest) + len(own_rest) - 2 * lcs)::DOUBLE / (fa + fb),
  CASE WHEN shared > 0 THEN greatest(1 - (1 + len(rest))::DOUBLE / (shared + fa), 1 - (1 + len(own_rest))::DOUBLE / (shared + fb)) ELSE 0 END) END AS score FROM fscored) WHERE score >= {C.ALIAS_SCORE} GROUP BY 1)"""


query("f3b_fuzzy", "ord", f", {_NAMED}, {_fuzzy("SELECT cleaned AS text FROM named WHERE quick IS NULL AND cleaned <> ''")} SELECT txn_id, coalesce(quick, name, cleaned) AS merchant_norm FROM named LEFT JOIN fuzzy ON quick IS NULL AND cleaned = text")(
    lambda l: C.normalized(l.drop("merchant_norm")).select("txn_id", "merchant_norm")
)
_TYPOS = f"""typos AS (SELECT p_partkey, CASE p_partkey // 40 % 4 WHEN 0 THEN substr(m, 1, k) || substr(m, k + 2) WHEN 1 THEN substr(m, 1, k) || 'Q' || substr(m, k + 1) WHEN 2 THEN 'STORE ' || substr(m, 1, k) || substr(m, k + 2) ELSE m || ' 12 ' || substr(m, 1, k) END AS text
FROM (SELECT *, CAST(p_partkey // 160 % len(m) AS INT) AS k FROM (SELECT p_partkey, upper({views._list(MERCHANTS)}[CAST(p_partkey % {len(MERCHANTS)} + 1 AS INT)]) AS m FROM part)))"""


@query("j7_fuzzy_join", None, f", {_TYPOS}, {_fuzzy('SELECT text FROM typos')} SELECT p_partkey, text, name AS merchant FROM typos LEFT JOIN fuzzy USING (text)")
def _j7(spark, sf_dir):
    """Merchants' names as people misspell them, one for each part, and the names they are taken for."""
    from ..operators.fuzzy import best_names

    key = F.col("p_partkey")
    typos = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.upper(views._pick(MERCHANTS, key)).alias("m"))
    m = F.col("m")
    typos = typos.withColumn("k", (F.floor(key / 160) % F.length(m)).cast("int"))
    head, kind = F.substring(m, F.lit(1), F.col("k")), F.floor(key / 40) % 4
    without = F.concat(head, F.substring(m, F.col("k") + 2, F.length(m)))
    text = F.when(kind == 0, without).when(kind == 1, F.concat(head, F.lit("Q"), F.substring(m, F.col("k") + 1, F.length(m)))).when(kind == 2, F.concat(F.lit("STORE "), without)).otherwise(F.concat(m, F.lit(" 12 "), head))
    typos = typos.select("p_partkey", text.alias("text"))
    return typos.join(best_names(typos, MERCHANTS, C.ALIAS_SCORE).withColumnRenamed("name", "merchant"), "text", "left").select("p_partkey", "text", "merchant")


query("f5_rule_match", "ord", f", {_NAMED} SELECT txn_id, rule_category FROM ruled")(lambda l: _ruled(l).select("txn_id", "rule_category"))


@query("f5_keyword_table", None, "SELECT o_orderkey, value FROM (SELECT o_orderkey, o_custkey FROM orders) LEFT JOIN LATERAL (SELECT arg_min(p_name, p_partkey) AS value FROM part WHERE contains(upper(printf('paid %d to CUST#%d REF %d', o_orderkey, o_custkey, o_orderkey * 7919)), printf('#%d R', p_partkey))) ON true")
def _f5_table(spark, sf_dir):
    """Descriptions against a rule for each part: more rules than an expression can hold."""
    from ..operators.keywords import first_keywords

    key = F.col("p_partkey")
    rules = spark.read.parquet(f"{sf_dir}/part.parquet").select(key.alias("at"), F.format_string("#%d R", key).alias("keyword"), F.col("p_name").alias("value"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.format_string("paid %d to CUST#%d REF %d", "o_orderkey", "o_custkey", F.col("o_orderkey") * 7919).alias("text"))
    return rows.join(first_keywords(rows, rules), "text", "left").select("o_orderkey", "value")


query("f6_rule_coverage", "ord", f", {_NAMED} SELECT raw_description, bool_or(rule_category IS NOT NULL) AS covered, count(*) AS n FROM ruled GROUP BY 1")(
    lambda l: _ruled(l).groupBy("raw_description").agg(F.bool_or(F.col("rule_category").isNotNull()).alias("covered"), F.count("*").alias("n"))
)
query("f7_cascade", "ord", f""", {_NAMED}, fix AS (SELECT 'Kroger' AS m, 'Food & Drink>Restaurants' AS c)
SELECT txn_id, coalesce(c, rule_category, 'Other>Uncategorized') AS category, CASE WHEN c IS NOT NULL THEN 'user' WHEN rule_category IS NOT NULL THEN 'rule' END AS category_source,
CASE WHEN c IS NOT NULL OR rule_category IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS category_confidence FROM ruled LEFT JOIN fix ON quick = m""")(
    lambda l: C.categorized(_named(l).withColumn("merchant_norm", F.col("quick")).drop("category"), l.sparkSession.createDataFrame([("Kroger", "Food & Drink>Restaurants")], "merchant_norm string, user_category string")).select("txn_id", "category", "category_source", "category_confidence")
)
_ELIGIBLE = "regexp_matches(upper(raw_description), 'TRANSFER|ZELLE|PAYMENT THANK YOU|PMT TO|PAYMENT')"
_PAIRS = f"""el AS (SELECT * FROM mv WHERE {_ELIGIBLE}), pairs AS (SELECT a.txn_id AS a_id, b.txn_id AS b_id, date_diff('day', a.posted_date, b.posted_date) AS gap FROM el a JOIN el b
ON a.amount = -b.amount AND a.account_id <> b.account_id AND (b.posted_date > a.posted_date OR b.posted_date = a.posted_date AND a.txn_id < b.txn_id) AND date_diff('day', a.posted_date, b.posted_date) <= 3)"""
query("f8_transfer_override", "mv", f", {_PAIRS} SELECT txn_id, CASE WHEN txn_id IN (SELECT a_id FROM pairs UNION SELECT b_id FROM pairs) THEN 'Transfers>Internal Transfer' ELSE 'Other>Uncategorized' END AS category FROM mv")(
    lambda l: C.categorized(l.drop("category"), transfers=X.transfer_ids(X.transfer_pairs(l))).select("txn_id", "category")
)
query("f9_transfer_kw", "ord", f"SELECT txn_id, {_ELIGIBLE} AS transferish FROM ord")(lambda l: l.select("txn_id", T.looks_like_transfer(F.col("raw_description")).alias("transferish")))
query("f10_bucket", "ev", "SELECT txn_id, CAST(CASE WHEN abs(amount) < 1 THEN 0 ELSE least(floor(log2(abs(amount))) + 1, 9) END AS BIGINT) AS bucket FROM ev")(lambda l: l.select("txn_id", T.amount_bucket(F.col("amount")).alias("bucket")))
query("f11_numeric_features", "ev", "SELECT txn_id, amount < 0 AS is_outflow, CAST(isodow(posted_date) - 1 AS BIGINT) AS weekday, isodow(posted_date) >= 6 AS is_weekend FROM ev")(
    lambda l: l.select("txn_id", (F.col("amount") < 0).alias("is_outflow"), F.weekday("posted_date").cast("long").alias("weekday"), (F.weekday("posted_date") >= 5).alias("is_weekend"))
)
query("f12_text_feature", "ord", f"SELECT txn_id, trim({_CLEAN} || ' ' || merchant_norm) AS feature FROM ord")(lambda l: l.select("txn_id", F.trim(F.concat_ws(" ", T.clean_descriptor(F.col("raw_description")), "merchant_norm")).alias("feature")))
query("f13_state", "ord", "SELECT txn_id, nullif(regexp_extract(raw_description, '\\b(GA|TX|CO|WA|ID|FL|NY|CA)\\b', 1), '') AS state FROM ord")(lambda l: l.select("txn_id", T.state(F.col("raw_description")).alias("state")))
query("f14_txn_id", "ord", "SELECT txn_id AS source_id, substr(sha256(account_id || '|' || strftime(posted_date, '%Y-%m-%d') || '|' || txn_id || '.00|' || raw_description || '|0'), 1, 16) AS txn_id FROM ord")(
    lambda l: l.select(F.col("txn_id").alias("source_id"), T.txn_id(F.col("account_id").cast("string"), F.col("posted_date"), F.concat(F.col("txn_id").cast("string"), F.lit(".00")), F.col("raw_description"), F.lit(0)).alias("txn_id"))
)
query("f15_month", "ord", "SELECT strftime(posted_date, '%Y-%m') AS month, count(*) AS n FROM ord GROUP BY 1")(lambda l: l.groupBy(F.date_format("posted_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n")))
query("f16_category_filter", "ord", "SELECT category, count(*) AS n FROM ord WHERE NOT starts_with(category, 'Transfers>') GROUP BY 1")(lambda l: l.where(~F.col("category").startswith("Transfers>")).groupBy("category").agg(F.count("*").alias("n")))
query("f17_root_leaf", "ord", "SELECT split_part(category, '>', 1) AS root, split_part(category, '>', 2) AS leaf, count(*) AS n FROM ord GROUP BY 1, 2")(
    lambda l: l.groupBy(F.split_part("category", F.lit(">"), F.lit(1)).alias("root"), F.split_part("category", F.lit(">"), F.lit(2)).alias("leaf")).agg(F.count("*").alias("n"))
)
query("f18_json_reasons", "ord", "SELECT txn_id, '[\"' || merchant_norm || '\",\"x\"]' AS reasons FROM ord")(lambda l: l.select("txn_id", F.to_json(F.array("merchant_norm", F.lit("x"))).alias("reasons")))
query("f20_page", "ord", "SELECT txn_id, posted_date FROM ord WHERE account_id = 3 ORDER BY posted_date, txn_id LIMIT 100 OFFSET 50")(lambda l: l.where("account_id = 3").orderBy("posted_date", "txn_id").offset(50).limit(100).select("txn_id", "posted_date"))

# joins

query("j1_candidate_pairs", "mv", f", {_PAIRS} SELECT * FROM pairs")(X.candidate_pairs)
query("j1_greedy", "mv", f", {_PAIRS} SELECT a_id, b_id FROM pairs")(X.transfer_pairs)
query("j3_exclude_transfers", "mv", f", {_PAIRS} SELECT txn_id, account_id FROM mv WHERE txn_id NOT IN (SELECT a_id FROM pairs UNION SELECT b_id FROM pairs)")(lambda l: X.without_transfers(l, X.transfer_pairs(l)).select("txn_id", "account_id"))

# aggregates

query("a1_monthly", "ord", "SELECT strftime(posted_date, '%Y-%m') AS month, category, round(sum(abs(amount)), 2) AS total FROM ord WHERE category IS NOT NULL AND NOT starts_with(category, 'Transfers>') GROUP BY 1, 2")(
    lambda l: l.where(F.col("category").isNotNull() & ~F.col("category").startswith("Transfers>")).groupBy(F.date_format("posted_date", "yyyy-MM").alias("month"), "category").agg(r(F.sum(F.abs("amount")), 2).alias("total"))
)
_MAD = "m1 AS (SELECT *, median(abs(amount)) OVER (PARTITION BY account_id, category) AS med FROM ord), m2 AS (SELECT *, greatest(median(abs(abs(amount) - med)) OVER (PARTITION BY account_id, category), 1.0::DOUBLE) AS mad FROM m1), m3 AS (SELECT *, 0.6745::DOUBLE * (abs(amount) - med) / mad AS z FROM m2)"
query("a2_mad", "ord", f", {_MAD} SELECT DISTINCT account_id, category, round(med, 4) AS med, round(mad, 4) AS mad FROM m3")(lambda l: D.mad_scores(l).select("account_id", "category", r("med").alias("med"), r("mad").alias("mad")).distinct())
query("a3_daily_rate", "ev", "SELECT account_id, round(avg(n), 6) AS rate FROM (SELECT account_id, posted_date, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY 1")(
    lambda l: l.groupBy("account_id", "posted_date").count().groupBy("account_id").agg(r(F.avg("count"), 6).alias("rate"))
)
_STATE = "st AS (SELECT *, nullif(regexp_extract(raw_description, '\\b(GA|TX|CO|WA|ID|FL|NY|CA)\\b', 1), '') AS state FROM ord), home AS (SELECT account_id, state AS home FROM (SELECT account_id, state, row_number() OVER (PARTITION BY account_id ORDER BY count(*) DESC, state) AS k FROM st WHERE state IS NOT NULL GROUP BY 1, 2) WHERE k = 1)"
query("a4_mode_state", "ord", f", {_STATE} SELECT * FROM home")(lambda l: l.withColumn("state", T.state(F.col("raw_description"))).groupBy("account_id").agg(F.mode("state", True).alias("home")).where("home IS NOT NULL"))
query("a5_dow_hist", "ord", f"SELECT {ROW}, CAST(isodow(posted_date) - 1 AS BIGINT) AS weekday, count(*) AS n FROM ord GROUP BY ALL")(lambda l: l.groupBy("account_id", "merchant_norm", F.weekday("posted_date").cast("long").alias("weekday")).agg(F.count("*").alias("n")))
query("a6_cat_freq", "ord", "SELECT account_id, category, round(count(*) / sum(count(*)) OVER (PARTITION BY account_id), 6) AS freq FROM ord GROUP BY 1, 2")(
    lambda l: l.groupBy("account_id", "category").agg(F.count("*").alias("n")).select("account_id", "category", r(F.col("n") / F.sum("n").over(Window.partitionBy("account_id")), 6).alias("freq"))
)
_GAPS = "gaps AS (SELECT *, date_diff('day', lag(posted_date) OVER w, posted_date) AS gap, row_number() OVER (PARTITION BY account_id, merchant_norm ORDER BY posted_date DESC, txn_id DESC) AS age FROM {v} WINDOW w AS (PARTITION BY account_id, merchant_norm ORDER BY posted_date, txn_id))"
_STATS = ", ".join(f"avg(CASE WHEN gap IS NULL THEN NULL WHEN abs(gap - {d}) <= {t} THEN 1 ELSE 0 END) AS p_{n}" for n, d, t, _ in PERIODS)
_GROUPS = (
    _GAPS + f", stats AS (SELECT {ROW}, count(*) AS n, {_STATS}, avg(abs(amount)) AS mean_amount, stddev_pop(abs(amount)) AS sd_amount, max(posted_date) AS last_date, median(amount) FILTER (age <= 3) AS band_mid, stddev_pop(amount) FILTER (age <= 3) AS band_sd FROM gaps GROUP BY ALL)"
    + ", s1 AS (SELECT *, greatest(p_weekly, p_biweekly, p_monthly, p_quarterly, p_annual) AS period_score, CASE WHEN mean_amount = 0 THEN 0.0::DOUBLE WHEN sd_amount / mean_amount <= 0.15 THEN 1.0::DOUBLE WHEN sd_amount / mean_amount <= 0.5 THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END AS amount_score FROM stats WHERE n >= 3)"
    + ", s2 AS (SELECT *, CASE WHEN period_score > 0 THEN CASE " + " ".join(f"WHEN p_{n} = period_score THEN '{n}'" for n, *_ in PERIODS) + " END END AS period, CASE WHEN period_score > 0 THEN CASE " + " ".join(f"WHEN p_{n} = period_score THEN {d}" for n, d, *_ in PERIODS) + " END END::BIGINT AS period_days,"
    + " round((CASE WHEN period_score < 0.85 AND amount_score < 0.6 THEN period_score * amount_score ELSE greatest(period_score * amount_score, 0.9::DOUBLE * least(period_score, amount_score)) END) * least(1.0::DOUBLE, n / 6), 3) AS confidence FROM s1)"
    + ", grp AS (SELECT *, CAST(last_date + CAST(period_days AS INT) AS DATE) AS predicted_next FROM s2 WHERE confidence >= 0.5 AND period IS NOT NULL), mem AS (SELECT v.*, period, period_days, confidence FROM {v} v JOIN grp USING (account_id, merchant_norm))"
)
_PLANT, _ORD = _GROUPS.replace("{v}", "plant"), _GROUPS.replace("{v}", "ord")
query("a7_group_stats", "ord", f", {_ORD} SELECT {ROW}, n, round(p_monthly, 6) AS p_monthly, round(mean_amount, 6) AS mean_amount, round(sd_amount, 6) AS sd_amount FROM stats")(
    lambda l: R.group_stats(l).select("account_id", "merchant_norm", "n", r("p_monthly", 6).alias("p_monthly"), r("mean_amount", 6).alias("mean_amount"), r("sd_amount", 6).alias("sd_amount"))
)
query("a8_best_period", "plant", f", {_PLANT} SELECT {ROW}, period, round(period_score, 6) AS period_score FROM s2")(lambda l: R.scored_groups(l).select("account_id", "merchant_norm", "period", r("period_score", 6).alias("period_score")))
query("a9_audit", "plant", f", {_PLANT} SELECT {ROW}, period, round(avg(abs(amount)) * a, 2) AS annualized, round(avg(abs(amount)) * a / 12, 2) AS monthly FROM (SELECT *, CASE period {' '.join(f"WHEN '{n}' THEN {y}" for n, _, _, y in PERIODS)} ELSE 12 END AS a FROM mem) GROUP BY {ROW}, period, a")(
    lambda l: R.subscription_audit(l, R.recurring_groups(l))
)
query("a10_audit_total", "plant", f", {_PLANT} SELECT period, count(*) AS n, round(sum(m), 2) AS monthly FROM (SELECT {ROW}, period, round(avg(abs(amount)) * a / 12, 2) AS m FROM (SELECT *, CASE period {' '.join(f"WHEN '{n}' THEN {y}" for n, _, _, y in PERIODS)} ELSE 12 END AS a FROM mem) GROUP BY {ROW}, period, a) GROUP BY 1")(
    lambda l: R.subscription_audit(l, R.recurring_groups(l)).groupBy("period").agg(F.count("*").alias("n"), r(F.sum("monthly"), 2).alias("monthly"))
)
query("a11_accounts", "ev", "SELECT DISTINCT account_id FROM ev")(lambda l: l.select("account_id").distinct())
query("a12_counts", "ord", "SELECT account_id, count(*) AS n, count(DISTINCT merchant_norm) AS merchants FROM ord GROUP BY 1")(lambda l: l.groupBy("account_id").agg(F.count("*").alias("n"), F.count_distinct("merchant_norm").alias("merchants")))
query("a13_cold_start", "ev", "SELECT account_id, count(*) < 30 OR date_diff('day', min(posted_date), max(posted_date)) < 30 AS cold_start FROM ev GROUP BY 1")(lambda l: D.cold_start(l).select("account_id", "cold_start").distinct())
query("a15_as_of", "plant", "SELECT account_id, max(posted_date) AS as_of FROM plant GROUP BY 1")(lambda l: l.groupBy("account_id").agg(F.max("posted_date").alias("as_of")))
query("a17_yearly_spend", "ord", "SELECT account_id, year(posted_date) AS y, month(posted_date) AS m, round(sum(-amount), 2) AS spend FROM ord GROUP BY ALL")(
    lambda l: l.groupBy("account_id", F.year("posted_date").cast("long").alias("y"), F.month("posted_date").cast("long").alias("m")).agg(r(F.sum(-F.col("amount")), 2).alias("spend"))
)

# windows

query("n1_occurrence", "ev", "SELECT txn_id, row_number() OVER (PARTITION BY account_id, posted_date, merchant_norm ORDER BY txn_id) - 1 AS occurrence FROM ev")(
    lambda l: l.select("txn_id", (F.row_number().over(Window.partitionBy("account_id", "posted_date", "merchant_norm").orderBy("txn_id")) - 1).cast("long").alias("occurrence"))
)
query("n2_gaps", "ord", f", {_ORD} SELECT txn_id, gap FROM gaps")(lambda l: R.gaps(l).select("txn_id", "gap"))
query("n3_first_seen", "ord", f"SELECT txn_id, row_number() OVER (PARTITION BY {ROW} ORDER BY posted_date, txn_id) = 1 AS first_seen FROM ord")(lambda l: D.new_merchant(l).select("txn_id", "first_seen"))
query("n4_running_max", "ev", "SELECT txn_id, max(abs(amount)) OVER (PARTITION BY account_id ORDER BY posted_date, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top_before FROM ev")(lambda l: D.extreme_amount(l).select("txn_id", "top_before"))
_DUP = "dup AS (SELECT *, CASE WHEN date_diff('day', posted_date, lead(posted_date) OVER w) <= 1 THEN date_diff('day', posted_date, lead(posted_date) OVER w) WHEN date_diff('day', lag(posted_date) OVER w, posted_date) <= 1 THEN date_diff('day', lag(posted_date) OVER w, posted_date) END AS dup_gap FROM {v} WINDOW w AS (PARTITION BY account_id, merchant_norm, amount ORDER BY posted_date, txn_id))"
query("n5_duplicates", "plant", f", {_DUP.replace('{v}', 'plant')} SELECT txn_id, dup_gap FROM dup WHERE dup_gap IS NOT NULL")(lambda l: D.duplicate_charge(l).where("dup_gap IS NOT NULL").select("txn_id", "dup_gap"))
_OLD = "old AS (SELECT *, abs(amount) AS new, median(abs(amount)) OVER (PARTITION BY account_id, merchant_norm ORDER BY posted_date, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM {v})"
query("n6_expanding_median", "ord", f", {_OLD.replace('{v}', 'ord')} SELECT txn_id, round(old, 4) AS old FROM old")(
    lambda l: with_expanding_median(l.select("account_id", "merchant_norm", "posted_date", "txn_id", "amount"), ["account_id", "merchant_norm"], ["posted_date", "txn_id"], F.abs("amount"), "old").select("txn_id", r("old").alias("old"))
)
query("n7_dup_billing", "plant", f", {_PLANT}, pv AS (SELECT *, lag(posted_date) OVER (PARTITION BY {ROW} ORDER BY posted_date, txn_id) AS prev_date FROM mem) SELECT {ROW}, txn_id, prev_date, posted_date, abs(amount) AS charged FROM pv WHERE date_diff('day', prev_date, posted_date) <= 3")(
    lambda l: R.duplicate_billing(l, R.recurring_groups(l))
)
query("n8_trailing_band", "plant", f", {_PLANT} SELECT {ROW}, round(band_mid, 4) AS band_mid, round(coalesce(band_sd, 0), 4) AS band_sd FROM stats")(lambda l: R.group_stats(l).select("account_id", "merchant_norm", r("band_mid").alias("band_mid"), r("band_sd").alias("band_sd")))
query("n9_pct_rank", "ev", "SELECT txn_id, round((rank() OVER (PARTITION BY account_id ORDER BY amount) + (count(*) OVER (PARTITION BY account_id, amount) - 1) / 2) / count(*) OVER (PARTITION BY account_id), 9) AS pct FROM ev")(
    lambda l: l.select("txn_id", r(D.percentile_of_history("amount"), 9).alias("pct"))
)
query("n10_gap_since", "ev", "SELECT txn_id, coalesce(date_diff('day', lag(posted_date) OVER (PARTITION BY account_id ORDER BY posted_date, txn_id), posted_date), 0) AS gap FROM ev")(
    lambda l: l.select("txn_id", F.coalesce(F.datediff("posted_date", F.lag("posted_date").over(D.account_order())), F.lit(0)).cast("long").alias("gap"))
)
query("n11_next_date", "plant", f", {_PLANT} SELECT {ROW}, last_date, predicted_next FROM grp")(lambda l: R.recurring_groups(l).select("account_id", "merchant_norm", "last_date", "predicted_next"))

# detectors

query("d1_outlier", "ord", f", {_MAD} SELECT txn_id, round(CASE WHEN z > 3.5 THEN least(1.0::DOUBLE, z / 10) END, 6) AS score, round(z, 4) AS z FROM m3")(lambda l: D.amount_outlier(l).select("txn_id", r("s_outlier", 6).alias("score"), r("z").alias("z")))
query("d2_new_merchant", "ord", f"SELECT txn_id, round(least(1.0::DOUBLE, abs(amount) / 500), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY {ROW} ORDER BY posted_date, txn_id) AS k FROM ord) WHERE k = 1 AND abs(amount) > 50")(
    lambda l: D.new_merchant(l).where("s_new IS NOT NULL").select("txn_id", r("s_new", 6).alias("score"))
)
_BOTH = "bills AS (SELECT * FROM plant UNION ALL SELECT * FROM ev WHERE txn_id % 5 = 0), " + _GROUPS.replace("{v}", "bills")


@query("j8_suppress", None, f", {_BOTH} SELECT account_id, merchant_norm, txn_id, g.account_id IS NOT NULL AS suppressed FROM (SELECT *, row_number() OVER (PARTITION BY {ROW} ORDER BY posted_date, txn_id) AS k FROM bills) x LEFT JOIN (SELECT account_id, merchant_norm FROM grp) g USING (account_id, merchant_norm) WHERE k = 1 AND abs(amount) > 50")
def _j8(spark, sf_dir):
    """First charges of merchants: subscriptions, whose recurring groups suppress them, and single purchases."""
    bills = views.planted(spark, sf_dir).unionByName(views.events(spark, sf_dir).where("txn_id % 5 = 0"))
    rows = D.dealt(bills)
    every, kept = D.new_merchant(rows), D.new_merchant(rows, R.recurring_groups(bills))
    left = kept.where("s_new IS NOT NULL").select("txn_id", "account_id", F.lit(False).alias("kept")).hint("merge")  # grows with the bills
    return every.where("s_new IS NOT NULL").join(left, ["txn_id", "account_id"], "left").select("account_id", "merchant_norm", "txn_id", F.col("kept").isNull().alias("suppressed"))


query("j9_members", "plant", f", {_PLANT} SELECT txn_id, period FROM mem")(lambda l: R.members(l, R.recurring_groups(l)).select("txn_id", "period"))
_VELO = """day AS (SELECT account_id, posted_date, count(*) AS c FROM {v} GROUP BY 1, 2), rate AS (SELECT account_id, avg(c) AS m FROM day GROUP BY 1),
velo AS (SELECT account_id, posted_date, c, 1 - list_sum(list_transform(range(c), lambda k: exp(k * ln(m) - m - list_sum(list_transform(range(1, k + 1), lambda i: ln(i)) || [0.0::DOUBLE])))) AS p FROM day JOIN rate USING (account_id) WHERE c >= 3)"""
query("d3_velocity", "ev", f", {_VELO.replace('{v}', 'ev')} SELECT txn_id, c AS day_count, round(p, 6) AS p_day FROM ev JOIN velo USING (account_id, posted_date)")(
    lambda l: D.velocity(l).where("day_count >= 3").select("txn_id", "day_count", r("p_day", 6).alias("p_day"))
)
query("d4_duplicate", "plant", f", {_DUP.replace('{v}', 'plant')} SELECT txn_id, 1.0::DOUBLE AS score FROM dup WHERE dup_gap IS NOT NULL")(lambda l: D.duplicate_charge(l).where("s_duplicate IS NOT NULL").select("txn_id", F.col("s_duplicate").alias("score")))
query("d5_geo", "ord", f", {_STATE} SELECT txn_id, CASE WHEN state <> home THEN 0.15::DOUBLE END AS score FROM st LEFT JOIN home USING (account_id)")(lambda l: D.geo_mismatch(l).select("txn_id", F.col("s_geo").alias("score")))
_DOW = "dw AS (SELECT *, count(*) OVER (PARTITION BY account_id, merchant_norm, isodow(posted_date)) AS on_day, count(*) OVER (PARTITION BY account_id, merchant_norm) AS nm FROM ord), dx AS (SELECT *, max(on_day) OVER (PARTITION BY account_id, merchant_norm) AS top FROM dw)"
query("d6_dow", "ord", f", {_DOW} SELECT txn_id, CASE WHEN nm >= 5 AND on_day < 2 AND top >= 2 THEN 0.2::DOUBLE END AS score FROM dx")(lambda l: D.unusual_weekday(l).select("txn_id", F.col("s_weekday").alias("score")))
query("d7_extreme", "ev", "SELECT txn_id FROM (SELECT *, max(abs(amount)) OVER (PARTITION BY account_id ORDER BY posted_date, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM ev) WHERE t > 0 AND abs(amount) > 5 * t")(lambda l: D.extreme_amount(l).where("s_extreme IS NOT NULL").select("txn_id"))
_RULES = f"""{_MAD}, {_STATE}, {_DOW}, {_DUP.replace('{v}', 'ord')}, {_VELO.replace('{v}', 'ord')},
sig AS (SELECT o.txn_id, o.account_id, CASE WHEN z > 3.5 THEN least(1.0::DOUBLE, z / 10) END AS s1,
  CASE WHEN row_number() OVER (PARTITION BY o.account_id, o.merchant_norm ORDER BY o.posted_date, o.txn_id) = 1 AND abs(o.amount) > 50 THEN least(1.0::DOUBLE, abs(o.amount) / 500) END AS s2,
  CASE WHEN p < 0.01 THEN least(1.0::DOUBLE, 1 - p) END AS s3, CASE WHEN dup_gap IS NOT NULL THEN 1.0::DOUBLE END AS s4, CASE WHEN st.state <> home THEN 0.15::DOUBLE END AS s5, CASE WHEN nm >= 5 AND on_day < 2 AND top >= 2 THEN 0.2::DOUBLE END AS s6,
  CASE WHEN abs(o.amount) > 5 * max(abs(o.amount)) OVER (PARTITION BY o.account_id ORDER BY o.posted_date, o.txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1.0::DOUBLE END AS s7,
  count(*) OVER (PARTITION BY o.account_id) < 30 OR date_diff('day', min(o.posted_date) OVER (PARTITION BY o.account_id), max(o.posted_date) OVER (PARTITION BY o.account_id)) < 30 AS cold
  FROM ord o JOIN m3 USING (txn_id) JOIN st USING (txn_id) LEFT JOIN home ON home.account_id = o.account_id JOIN dx USING (txn_id) JOIN dup USING (txn_id) LEFT JOIN velo ON velo.account_id = o.account_id AND velo.posted_date = o.posted_date),
scored AS (SELECT *, round(CASE WHEN cold THEN greatest(0.0::DOUBLE, coalesce(s4, 0), coalesce(s7, 0)) ELSE greatest(0.0::DOUBLE, coalesce(s1, 0), coalesce(s2, 0), coalesce(s3, 0), coalesce(s4, 0), coalesce(s5, 0), coalesce(s6, 0)) END, 6) AS rule_score,
  CASE WHEN cold THEN (s4 IS NOT NULL)::INT + (s7 IS NOT NULL)::INT ELSE (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT + (s4 IS NOT NULL)::INT + (s5 IS NOT NULL)::INT + (s6 IS NOT NULL)::INT END AS n_reasons FROM sig)"""
query("d8_merge", "ord", f", {_RULES} SELECT txn_id, rule_score, CAST(n_reasons AS BIGINT) AS n_reasons FROM scored")(lambda l: D.rule_scores(l).select("txn_id", r("rule_score", 6).alias("rule_score"), F.size("anomaly_reasons").cast("long").alias("n_reasons")))
_PCT = "round((rank() OVER (PARTITION BY account_id ORDER BY rule_score) + (count(*) OVER (PARTITION BY account_id, rule_score) - 1) / 2) / count(*) OVER (PARTITION BY account_id), 9)"
query("d10_rule_score", "ord", f", {_RULES} SELECT txn_id, account_id, rule_score, {_PCT} AS anomaly_score FROM scored")(
    lambda l: D.rule_scores(l).withColumn("rule_score", r("rule_score", 6)).select("txn_id", "account_id", "rule_score", r(D.percentile_of_history("rule_score"), 9).alias("anomaly_score"))
)
query("d11_recurring", "plant", f", {_PLANT} SELECT {ROW}, n, period, confidence FROM s2")(lambda l: R.scored_groups(l).select("account_id", "merchant_norm", "n", "period", "confidence"))
query("d12_price_hike", "plant", f", {_PLANT}, {_OLD.replace('{v}', 'mem')} SELECT {ROW}, txn_id, posted_date, round(old, 2) AS old_amount, round(new, 2) AS new_amount, round((new - old) / old, 3) AS pct_change FROM old WHERE old > 0 AND new - old > 2.0 AND (new - old) / old > 0.10")(
    lambda l: R.price_hikes(l, R.recurring_groups(l))
)
query("d13_missed", "plant", f", {_PLANT} SELECT {ROW}, predicted_next, date_diff('day', predicted_next, DATE '2017-01-01') AS days_late FROM grp WHERE date_diff('day', predicted_next, DATE '2017-01-01') > 5")(
    lambda l: R.missed_charges(R.recurring_groups(l), F.lit("2017-01-01").cast("date")).select("account_id", "merchant_norm", "predicted_next", "days_late")
)
query("d18_topk", "ev", "SELECT txn_id, amount FROM ev ORDER BY amount, txn_id LIMIT 20")(lambda l: l.orderBy("amount", "txn_id").limit(20).select("txn_id", "amount"))

# writes, sets, sorting

@query("w1_upsert_anti", None, "SELECT DISTINCT ON (txn_id) txn_id, account_id FROM ord WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_id = txn_id)")
def _w1(spark, sf_dir):
    from ..operators.store import absent

    return absent(views.orders(spark, sf_dir), views.events(spark, sf_dir)).select("txn_id", "account_id")


@query("w3_latest_correction", "ev", "SELECT merchant_norm, arg_max(account_id, (posted_date, txn_id)) AS latest FROM ev GROUP BY 1")
def _w3(l):
    from ..operators.store import latest

    return latest(l, ["merchant_norm"], ["posted_date", "txn_id"]).select("merchant_norm", F.col("account_id").alias("latest"))


@query("u1_union", None, "SELECT txn_id, account_id, amount FROM plant UNION ALL SELECT txn_id, account_id, amount FROM mv")
def _u1(spark, sf_dir):
    return views.planted(spark, sf_dir).unionByName(views.moved(spark, sf_dir)).select("txn_id", "account_id", "amount")


@query("u2_except", None, "SELECT account_id FROM mv EXCEPT SELECT account_id FROM ev")
def _u2(spark, sf_dir):
    return views.moved(spark, sf_dir).select("account_id").subtract(views.events(spark, sf_dir).select("account_id"))


query("u4_distinct", "ord", "SELECT DISTINCT account_id, merchant_norm FROM ord")(lambda l: l.select("account_id", "merchant_norm").distinct())
query("t3_sorted_totals", "ord", "SELECT category, round(sum(abs(amount)), 2) AS total FROM ord GROUP BY 1 ORDER BY 2 DESC")(lambda l: l.groupBy("category").agg(r(F.sum(F.abs("amount")), 2).alias("total")).orderBy(F.desc("total")))


# models: no statement for DuckDB, tested by invariants


@query("d9_forest", "ord")
def _d9(l):
    from ..operators.forest import anomalies

    return anomalies(l).select("txn_id", "account_id", "forest_score", "anomaly_score", "anomaly_reasons")


_GRAMS = "flatten(list_transform(list_filter(string_split_regex(lower(cleaned), '\\s+'), lambda w: w <> ''), lambda w: flatten(list_transform(range(2, 6), lambda n: list_transform(range(1, greatest(len(w) + 4 - n, 1)), lambda i: substr(' ' || w || ' ', i, n))))))"


@query("m1_ngrams", "ord", f", {_NAMED} SELECT gram, count(*) AS n FROM (SELECT unnest({_GRAMS}) AS gram FROM named) GROUP BY 1")
def _m1(l):
    from ..operators.classify import ngrams

    return l.select(F.explode(ngrams(T.clean_descriptor(F.col("raw_description")))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("m3_classifier", "ord")
def _m3(l):
    from ..operators.classify import fit

    return fit(l).predict(l).select("txn_id", "category", "model_category", "model_confidence")


@query("m4_calibration", "ord")
def _m4(l):
    """How far the averaged model's confidences are from its precision, and what each threshold keeps."""
    from ..operators.classify import calibration_error, fit, threshold_curve

    said = written(fit(l).predict(l).select("category", "model_category", "model_confidence"), "predicted")
    return threshold_curve(said).join(F.broadcast(calibration_error(said)))  # one row


@query("m4_error", "ev", "SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(off) / sum(n), 9) AS ece FROM (SELECT least(floor(conf * 10), 9) AS bin, count(*) AS n, abs(sum((said = category)::INT) - sum(conf)) AS off FROM (SELECT category, CASE WHEN txn_id % 4 = 0 THEN 'other' ELSE category END AS said, (txn_id * 37 % 100) / 100.0::DOUBLE AS conf FROM ev) GROUP BY 1)")
def _m4_error(l):
    from ..operators.classify import calibration_error

    said = F.when(F.col("txn_id") % 4 == 0, "other").otherwise(F.col("category"))
    rows = l.select("category", said.alias("model_category"), (F.col("txn_id") * 37 % 100 / 100.0).alias("model_confidence"))
    return calibration_error(rows).select("n", r("ece", 9).alias("ece"))


_SPLIT = """mm AS (SELECT DISTINCT category, merchant_norm FROM ord), mo AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(merchant_norm), merchant_norm) AS k, count(*) OVER (PARTITION BY category) AS n FROM mm),
split AS (SELECT ord.*, n > 1 AND k <= least(n - 1, greatest(1, round(n * 0.25::DOUBLE))) AS is_test FROM ord JOIN mo USING (category, merchant_norm))"""


@query("u3_disjoint", "ord", f", {_SPLIT} SELECT category, count(DISTINCT merchant_norm) FILTER (is_test) AS tests, count(DISTINCT merchant_norm) FILTER (NOT is_test) AS trains, (SELECT count(*) FROM (SELECT category, merchant_norm FROM split WHERE is_test INTERSECT SELECT category, merchant_norm FROM split WHERE NOT is_test)) AS both FROM split GROUP BY 1")
def _u3(l):
    from ..operators.classify import grouped_split

    rows = grouped_split(l)
    both = rows.where("is_test").select("category", "merchant_norm").intersect(rows.where("not is_test").select("category", "merchant_norm")).agg(F.count("*").alias("both"))
    counts = rows.groupBy("category").agg(F.count_distinct(F.when(F.col("is_test"), F.col("merchant_norm"))).alias("tests"), F.count_distinct(F.when(~F.col("is_test"), F.col("merchant_norm"))).alias("trains"))
    return counts.crossJoin(F.broadcast(both))  # one row


@query("m7_majority", "ord", f", {_SPLIT}, top AS (SELECT category AS model_category FROM split WHERE NOT is_test GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT category, model_category, count(*) AS n FROM split, top WHERE is_test GROUP BY 1, 2")
def _m7(l):
    from ..operators.classify import grouped_split, majority

    return majority(grouped_split(l)).groupBy("category", "model_category").agg(F.count("*").alias("n"))


@query("m8_threshold", "ev", "SELECT threshold, avg((conf >= threshold)::INT) AS coverage, avg(CASE WHEN conf >= threshold THEN (said = category)::INT END) AS precision FROM (SELECT category, CASE WHEN txn_id % 4 = 0 THEN 'other' ELSE category END AS said, (txn_id * 37 % 100) / 100.0::DOUBLE AS conf, unnest([0.3::DOUBLE, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS threshold FROM ev) GROUP BY 1")
def _m8(l):
    from ..operators.classify import threshold_curve

    said = F.when(F.col("txn_id") % 4 == 0, "other").otherwise(F.col("category"))
    return threshold_curve(l.select("category", said.alias("model_category"), (F.col("txn_id") * 37 % 100 / 100.0).alias("model_confidence")))


@query("m6_grouped_split", "ord", f", {_SPLIT} SELECT txn_id, category, merchant_norm, is_test FROM split")
def _m6(l):
    from ..operators.classify import grouped_split

    return grouped_split(l).select("txn_id", "category", "merchant_norm", "is_test")


_TRUTH = f"{_RULES}, pct AS (SELECT *, {_PCT} AS anomaly_score FROM scored), truth AS (SELECT pct.*, ord.amount < -450000 OR txn_id % 97 = 0 AS is_anomaly, CASE WHEN ord.amount < -450000 THEN 'large' ELSE 'planted' END AS anomaly_type FROM pct JOIN ord USING (txn_id))"


def _truth(l):
    """Scores beside a stated truth: large amounts and every 97th order."""
    rows = D.rule_scores(l).withColumn("rule_score", r("rule_score", 6)).withColumn("anomaly_score", r(D.percentile_of_history("rule_score"), 9))
    large = F.col("amount") < -450000
    return rows.withColumn("is_anomaly", large | (F.col("txn_id") % 97 == 0)).withColumn("anomaly_type", F.when(large, "large").otherwise("planted"))


@query("a16_precision_at_k", "ord", f", {_TRUTH} SELECT account_id, avg(is_anomaly::INT) AS precision FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY anomaly_score DESC, txn_id) AS top FROM truth) WHERE top <= 10 GROUP BY 1")
def _a16(l):
    from ..operators.evaluate import precision_at_k

    return precision_at_k(_truth(l))


@query("a16_pr_auc", "ord", f", {_TRUTH}, step AS (SELECT account_id, anomaly_score, sum(is_anomaly::INT) AS hits, count(*) AS n FROM truth GROUP BY 1, 2), cum AS (SELECT *, sum(hits) OVER w AS found, sum(n) OVER w AS seen, sum(hits) OVER (PARTITION BY account_id) AS total FROM step WINDOW w AS (PARTITION BY account_id ORDER BY anomaly_score DESC)) SELECT account_id, round(sum(found / seen * hits) / nullif(max(total), 0), 6) AS pr_auc FROM cum GROUP BY 1")
def _a16_auc(l):
    from ..operators.evaluate import pr_auc

    return pr_auc(_truth(l)).select("account_id", r("pr_auc", 6).alias("pr_auc"))


@query("a16_recall_by_type", "ord", f", {_TRUTH}, bar AS (SELECT account_id, quantile_cont(anomaly_score, 0.9) AS bar FROM truth GROUP BY 1) SELECT anomaly_type, round(avg((anomaly_score >= bar)::INT), 6) AS recall, count(*) AS n FROM truth JOIN bar USING (account_id) WHERE is_anomaly GROUP BY 1")
def _a16_types(l):
    from ..operators.evaluate import recall_by_type

    return recall_by_type(_truth(l)).select("anomaly_type", r("recall", 6).alias("recall"), "n")


query("f19_reasons", "ev", f""", {_VELO.replace('{v}', 'ev')}, {_DUP.replace('{v}', 'ev')}, firsts AS (SELECT *, row_number() OVER (PARTITION BY {ROW} ORDER BY posted_date, txn_id) AS k FROM ev),
tops AS (SELECT *, max(abs(amount)) OVER (PARTITION BY account_id ORDER BY posted_date, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM ev)
SELECT txn_id, 'new' AS signal, printf('first-ever transaction with ''%s'', amount $%.2f', merchant_norm, abs(amount)) AS reason FROM firsts WHERE k = 1 AND abs(amount) > 50
UNION ALL SELECT txn_id, 'velocity', printf('%d transactions on %s vs a typical %.1f/day for this account (p=%.4f)', c, strftime(posted_date, '%Y-%m-%d'), round(m, 1), round(p, 4)) FROM ev JOIN velo USING (account_id, posted_date) JOIN rate USING (account_id) WHERE p < 0.01
UNION ALL SELECT txn_id, 'duplicate', printf('duplicate charge: same merchant and amount ($%.2f) %d day(s) apart', abs(amount), dup_gap) FROM dup WHERE dup_gap IS NOT NULL
UNION ALL SELECT txn_id, 'extreme', printf('$%.2f is more than %.0fx anything seen on this account so far', abs(amount), 5.0::DOUBLE) FROM tops WHERE t > 0 AND abs(amount) > 5 * t""")(
    lambda l: D.extreme_amount(D.duplicate_charge(D.velocity(D.new_merchant(l)))).select("txn_id", F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(f"why_{n}").alias("reason")) for n in ("new", "velocity", "duplicate", "extreme")])).alias("x")).select("txn_id", "x.*").where("reason IS NOT NULL")
)


@query("w7_chase_lines", "ev", "SELECT concat_ws(',', CASE WHEN amount < 0 THEN 'DEBIT' ELSE 'CREDIT' END, strftime(posted_date, '%m/%d/%Y'), CASE WHEN regexp_matches(raw_description, '[\",\n]') THEN '\"' || replace(raw_description, '\"', '\"\"') || '\"' ELSE raw_description END, CAST(CAST(amount AS DECIMAL(12,2)) AS VARCHAR), 'ACH') AS value FROM ev UNION ALL SELECT 'Details,Posting Date,Description,Amount,Type'")
def _w7(l):
    from ..sources.writers import rendered

    return rendered(l, "chase").select("value")


# velocity and bursts by time

_AT = "timed AS (SELECT event_id AS txn_id, user_id AS account_id, ts, -value AS amount, CAST(round(-value * 100) AS BIGINT) AS cents FROM events)"


def _timed(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("txn_id"), F.col("user_id").alias("account_id"), "ts", (-F.col("value")).alias("amount"))


@query("v1_trailing", None, f""", {_AT} SELECT txn_id, account_id, count(*) OVER d AS n_24h, CAST(sum(cents) OVER d AS BIGINT) AS cents_24h, count(*) OVER w AS n_7d, CAST(sum(cents) OVER w AS BIGINT) AS cents_7d FROM timed
WINDOW d AS (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW), w AS (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)""")
def _v1(spark, sf_dir):
    from ..operators.trailing import trailing_counts

    return trailing_counts(_timed(spark, sf_dir)).drop("ts")


@query("v2_bursts", None, f""", {_AT}, isle AS (SELECT *, sum(new) OVER (PARTITION BY account_id ORDER BY ts, txn_id) AS island FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY account_id ORDER BY ts, txn_id) + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM timed)),
sess AS (SELECT account_id, min(ts) AS began, max(ts) + INTERVAL 2 HOURS AS ended, count(*) AS n, count(*) FILTER (abs(amount) <= 20) AS n_small, CAST(sum(abs(cents)) AS BIGINT) AS total_cents, min(ts) FILTER (abs(amount) <= 20) AS first_small, max(ts) FILTER (abs(amount) >= 50) AS last_large FROM isle GROUP BY account_id, island)
SELECT account_id, began, ended, n, n_small, total_cents FROM sess WHERE n_small >= 2 AND last_large > first_small""")
def _v2(spark, sf_dir):
    """Events lie hours apart, so sessions here have a gap of two hours."""
    from ..operators.trailing import bursts

    return bursts(_timed(spark, sf_dir), gap="2 hours", small=20.0, least=2, large=50.0)


@query("w7_capital_one_lines", "ord", f"""SELECT concat_ws(',', strftime(posted_date, '%Y-%m-%d'), strftime(posted_date, '%Y-%m-%d'), raw_description, hint, CASE WHEN amount < 0 THEN printf('%.2f', abs(amount)) ELSE '' END, CASE WHEN amount < 0 THEN '' ELSE printf('%.2f', abs(amount)) END) AS value
FROM (SELECT *, CASE WHEN CAST('0x' || substr(md5(CAST(txn_id AS VARCHAR)), 1, 4) AS INT) % 4 = 0 THEN {views._list(BANK_HINTS)}[CAST('0x' || substr(md5(CAST(txn_id AS VARCHAR)), 5, 4) AS INT) % {len(BANK_HINTS)} + 1] ELSE split_part(category, '>', 2) END AS hint FROM ord)
UNION ALL SELECT 'Transaction Date,Posted Date,Description,Category,Debit,Credit'""")
def _w7_capital_one(l):
    from ..sources.writers import rendered

    return rendered(l, "capital_one").select("value")


@query("d18_listing", "ord", f", {_RULES} SELECT txn_id, account_id, anomaly_score FROM (SELECT *, {_PCT} AS anomaly_score FROM scored) WHERE anomaly_score >= 0.9 AND account_id = 7 AND txn_id % 5 <> 0 ORDER BY anomaly_score DESC, txn_id LIMIT 50")
def _d18(l):
    """What users look at: an account's highest scores that nobody has acknowledged. Every fifth order is."""
    from ..operators.store import acknowledged, top_anomalies

    rows = D.rule_scores(l).withColumn("rule_score", r("rule_score", 6)).withColumn("anomaly_score", r(D.percentile_of_history("rule_score"), 9))
    acks = l.where(F.col("txn_id") % 5 == 0).select("txn_id")
    return top_anomalies(acknowledged(rows, acks), 0.9, 50, 7).select("txn_id", "account_id", "anomaly_score")


query("t4_audit_order", "plant", f", {_PLANT}, audit AS (SELECT {ROW}, period, round(avg(abs(amount)) * a, 2) AS annualized FROM (SELECT *, CASE period {' '.join(f"WHEN '{n}' THEN {y}" for n, _, _, y in PERIODS)} ELSE 12 END AS a FROM mem) GROUP BY {ROW}, period, a) SELECT {ROW}, annualized, row_number() OVER (PARTITION BY account_id ORDER BY annualized DESC, merchant_norm, period) AS place FROM audit")(
    lambda l: S.in_audit_order(R.subscription_audit(l, R.recurring_groups(l))).select("account_id", "merchant_norm", "annualized", "place")
)
