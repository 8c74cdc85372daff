"""DuckDB oracle SQL for the registered queries (run on the driver tables).

The binding CTE mirrors ``ledgerlens.sources.tables.bound_transactions``.
"""

from __future__ import annotations

TXN_CTE = """
WITH txn AS (
  SELECT 'syn:' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS source,
         l_shipdate AS txn_date,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
         'INR' AS currency,
         CASE WHEN l_linenumber = 7 THEN NULL
              WHEN l_linenumber = 5 AND day(l_shipdate) = 1 THEN 'City Rent'
              WHEN l_linenumber = 6 AND l_suppkey % 4 = 2 THEN 'the'
              WHEN l_linenumber = 6 AND l_suppkey % 4 = 0 THEN ''
              WHEN l_linenumber = 6 AND l_suppkey % 4 = 1 THEN 'Unknown'
              ELSE p_name END AS merchant,
         CASE p_type WHEN 'STANDARD' THEN NULL WHEN 'PROMO' THEN 'Other' ELSE p_type END AS category,
         CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END AS sub_category,
         CASE l_linenumber % 4 WHEN 0 THEN 'UPI' WHEN 1 THEN 'CREDIT CARD' WHEN 2 THEN 'NEFT' ELSE '' END
           AS payment_method,
         CASE l_suppkey % 3 WHEN 0 THEN 'HDFC' WHEN 1 THEN 'SBI' ELSE 'AXIS' END AS bank_name,
         l_shipdate AS created_at,
         CASE WHEN l_returnflag = 'R' THEN 'credit' ELSE 'debit' END AS txn_type,
         l_orderkey, l_linenumber, l_suppkey, p_name
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
expenses AS (SELECT * FROM txn WHERE txn_type = 'debit'),
credits AS (SELECT * FROM txn WHERE txn_type = 'credit')
"""

ORACLES: dict[str, str] = {}


def _sayings() -> str:
    """``conversations`` as ``ledgerlens.sources.tables.conversations`` binds it."""
    from ledgerlens.sources.tables import SAID_TURN, SAYINGS

    cases = " ".join(f"WHEN {k} THEN '" + v.replace("\n", "' || chr(10) || '") + "'" for k, v in SAYINGS.items())
    return (f"(SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn + {SAID_TURN}, role, "
            f"CASE (conv_id + turn) % 20 {cases} END FROM conversations WHERE (conv_id + turn) % 20 IN ({', '.join(map(str, SAYINGS))}))")


CONVERSATIONS = _sayings()
DOCUMENTS = """(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' A/c HDFC4**1234 debited INR 5, PIN ' ||
  lpad(CAST(doc_id % 1000000 AS VARCHAR), 6, '7') || ' Ref# 12' ELSE text END AS text FROM documents)"""


def oracle(name: str, body: str) -> None:
    ORACLES[name] = TXN_CTE + body


oracle("monthly_spend", """
SELECT CAST(date_trunc('month', txn_date) AS DATE) AS month,
       CAST(SUM(amount) AS DOUBLE) AS total_spent, COUNT(*) AS txn_count
FROM expenses GROUP BY 1
""")

oracle("category_spend", """
, per_category AS (
  SELECT CASE WHEN category IS NULL THEN 'Other' ELSE category END AS name, COUNT(*) AS n, SUM(amount) AS spent
  FROM expenses GROUP BY ALL)
SELECT p.name AS category, CAST(p.spent AS DOUBLE) AS total_spent, p.n AS txn_count,
       1 + (SELECT COUNT(*) FROM per_category q
            WHERE q.spent > p.spent OR (q.spent = p.spent AND q.name < p.name)) AS row_id
FROM per_category p
""")

oracle("top_merchants", """
SELECT merchant, CAST(SUM(amount) AS DOUBLE) AS total_spent, COUNT(*) AS txn_count,
       ROUND(CAST(SUM(amount) AS DOUBLE) / COUNT(*), 6) AS avg_amount
FROM expenses WHERE merchant IS NOT NULL
GROUP BY 1 ORDER BY SUM(amount) DESC, merchant ASC LIMIT 20
""")

oracle("income_vs_expense", """
SELECT CAST(date_trunc('month', txn_date) AS DATE) AS month,
       CAST(SUM(CASE WHEN txn_type = 'debit' THEN amount ELSE 0 END) AS DOUBLE) AS expenses,
       CAST(SUM(CASE WHEN txn_type = 'debit' THEN 0 ELSE amount END) AS DOUBLE) AS income,
       CAST(SUM(CASE WHEN txn_type = 'debit' THEN -amount ELSE amount END) AS DOUBLE) AS net
FROM txn GROUP BY 1
""")

oracle("quality_report", """
SELECT table_name, COUNT(*) AS total,
       COUNT(*) FILTER (WHERE merchant IS NULL OR merchant = '') AS missing_merchant,
       COUNT(*) FILTER (WHERE category = 'Other' OR category IS NULL) AS other_category,
       COUNT(*) FILTER (WHERE sub_category IS NULL OR sub_category = '') AS empty_sub_category
FROM (SELECT 'expenses' AS table_name, * FROM expenses UNION ALL SELECT 'credits' AS table_name, * FROM credits) t
GROUP BY table_name
""")

oracle("merchant_frequency", """
SELECT merchant, COUNT(*) AS cnt FROM expenses
WHERE merchant IS NOT NULL AND merchant <> ''
GROUP BY merchant ORDER BY cnt DESC, merchant ASC LIMIT 20
""")

oracle("field_population", """
, c AS (
  SELECT COUNT(*) AS total,
    COUNT(*) FILTER (WHERE amount IS NOT NULL) AS amount,
    COUNT(*) FILTER (WHERE txn_date IS NOT NULL) AS txn_date,
    COUNT(*) FILTER (WHERE merchant IS NOT NULL AND merchant <> '' AND merchant <> 'Unknown') AS merchant,
    COUNT(*) FILTER (WHERE category IS NOT NULL AND category <> 'Other') AS category,
    COUNT(*) FILTER (WHERE sub_category IS NOT NULL AND sub_category <> '') AS sub_category,
    COUNT(*) FILTER (WHERE payment_method IS NOT NULL AND payment_method <> '') AS payment_method,
    COUNT(*) FILTER (WHERE bank_name IS NOT NULL AND bank_name <> '') AS bank_name,
    0 AS embedding
  FROM expenses)
SELECT field, filled, total, CASE WHEN total > 0 THEN (filled * 100) // total END AS pct
FROM (
  SELECT 'amount' AS field, amount AS filled, total FROM c UNION ALL
  SELECT 'txn_date', txn_date, total FROM c UNION ALL
  SELECT 'merchant', merchant, total FROM c UNION ALL
  SELECT 'category', category, total FROM c UNION ALL
  SELECT 'sub_category', sub_category, total FROM c UNION ALL
  SELECT 'payment_method', payment_method, total FROM c UNION ALL
  SELECT 'bank_name', bank_name, total FROM c UNION ALL
  SELECT 'embedding', embedding, total FROM c) x
""")

oracle("category_breakdown", """
SELECT category, COUNT(*) AS cnt FROM expenses GROUP BY category
""")

oracle("payment_breakdown", """
SELECT payment_method, COUNT(*) AS cnt FROM expenses GROUP BY payment_method
""")

oracle("filtered_total", """
SELECT CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total FROM expenses
WHERE merchant ILIKE '%widget%' AND category ILIKE '%small%' AND payment_method ILIKE '%upi%'
  AND txn_date >= TIMESTAMP '1995-01-01 00:00:00' AND txn_date <= TIMESTAMP '1997-12-31 00:00:00'
""")

oracle("ilike_filters", """
SELECT source, txn_date, CAST(amount AS DOUBLE) AS amount, merchant, category, payment_method FROM expenses
WHERE merchant ILIKE '%gear%' AND category ILIKE '%m%' AND txn_date >= TIMESTAMP '1994-06-01 00:00:00'
""")

oracle("missing_merchant", """
SELECT CASE txn_type WHEN 'debit' THEN 'expenses' ELSE 'credits' END AS table_name, source, txn_date,
       CAST(amount AS DOUBLE) AS amount, merchant FROM txn
WHERE merchant IS NULL OR merchant = ''
""")

oracle("uncategorised", """
SELECT CASE txn_type WHEN 'debit' THEN 'expenses' ELSE 'credits' END AS table_name, source, txn_date,
       CAST(amount AS DOUBLE) AS amount, category FROM txn
WHERE category = 'Other' OR category IS NULL
""")

oracle("empty_sub_category", """
SELECT CASE txn_type WHEN 'debit' THEN 'expenses' ELSE 'credits' END AS table_name, source, txn_date,
       CAST(amount AS DOUBLE) AS amount, sub_category FROM txn
WHERE sub_category IS NULL OR sub_category = ''
""")

_REVIEW = """
, backlog AS (
  SELECT 'expenses' AS table_name, 0 AS table_rank, * FROM expenses
  WHERE merchant IS NULL OR merchant = '' OR merchant = 'Unknown' OR category = 'Other' OR category IS NULL
  UNION ALL
  SELECT 'credits' AS table_name, 1 AS table_rank, * FROM credits
  WHERE merchant IS NULL OR merchant = '' OR merchant = 'Unknown' OR category = 'Other' OR category IS NULL)
"""
_REVIEW_SELECT = """
SELECT table_name, source, txn_date, CAST(amount AS DOUBLE) AS amount, merchant, category, sub_category,
       payment_method, bank_name
FROM backlog
"""
_REVIEW_ORDER = """
ORDER BY table_rank ASC, txn_date DESC NULLS LAST, source ASC NULLS FIRST, amount ASC NULLS FIRST,
         merchant ASC NULLS FIRST, category ASC NULLS FIRST, sub_category ASC NULLS FIRST,
         payment_method ASC NULLS FIRST, bank_name ASC NULLS FIRST
"""

oracle("review_backlog", _REVIEW + _REVIEW_SELECT)
oracle("review_page", _REVIEW + _REVIEW_SELECT + _REVIEW_ORDER + " LIMIT 3 OFFSET 9")
oracle("review_totals", _REVIEW + "SELECT COUNT(*) AS total, (COUNT(*) + 2) // 3 AS total_pages FROM backlog")

oracle("bad_rows", """
SELECT source, CAST(amount AS DOUBLE) AS amount, merchant FROM expenses
WHERE amount > 10000000 OR merchant IN ('the', 'a', 'an')
""")

oracle("all_transactions", """
SELECT 'expenses' AS table_name, source, txn_date, CAST(amount AS DOUBLE) AS amount, merchant FROM expenses
UNION ALL
SELECT 'credits' AS table_name, source, txn_date, CAST(amount AS DOUBLE) AS amount, merchant FROM credits
""")

oracle("latest_records", """
SELECT source, created_at, CAST(amount AS DOUBLE) AS amount, merchant, category, sub_category,
       payment_method, bank_name
FROM expenses
ORDER BY created_at DESC, source ASC, amount ASC, merchant ASC NULLS FIRST, category ASC NULLS FIRST,
         sub_category ASC NULLS FIRST, payment_method ASC NULLS FIRST, bank_name ASC NULLS FIRST
LIMIT 5
""")


# --- alert text re-rendered in DuckDB from the same columns ------------------------------

ALERT_CTE = """
WITH li AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey),
a0 AS (
  SELECT 'syn:' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS message_id,
         l_linenumber % 4 AS kind, l_linenumber, l_orderkey, l_suppkey, l_returnflag, p_name, p_type, l_shipdate,
         split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS amt,
         lpad(CAST(l_suppkey % 10000 AS VARCHAR), 4, '0') AS card,
         epoch_ms(l_shipdate) AS ts_ms,
         CASE l_suppkey % 3 WHEN 0 THEN 'HDFC' WHEN 1 THEN 'SBI' ELSE 'Axis' END AS bank_name
  FROM li),
alerts AS (
  SELECT *, CASE kind
    WHEN 1 THEN 'INR ' || CAST(amt AS VARCHAR) || ' debited from a/c XX' || card || ' via UPI on '
                || strftime(l_shipdate, '%d/%m/%Y') || ' at ' || p_name
    WHEN 2 THEN 'Rs.' || format('{:,.2f}', amt) || ' spent on credit card XX' || card || ' on '
                || strftime(l_shipdate, '%d %b %Y') || ' at ' || upper(p_name) || ' INMUMBAI'
    WHEN 3 THEN 'Rs ' || CAST(amt AS VARCHAR) || ' debited from A/c no. XX' || card || ' on '
                || strftime(l_shipdate, '%d-%m-%y') || ' to VPA ' || replace(p_name, ' ', '.')
                || '@okaxis (UPI Ref No ' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || ')'
    ELSE 'Your a/c XX' || card || ' is ' || CASE WHEN l_suppkey % 2 = 0 THEN 'debited' ELSE 'credited' END
                || ' by INR ' || CAST(amt AS VARCHAR) || ' via NEFT. Info: ' || upper(p_name)
  END AS text,
  upper(substr(split_part(p_name, ' ', 2), 1, 1)) || lower(substr(split_part(p_name, ' ', 2), 2)) AS vpa_name,
  CASE WHEN kind = 0 AND l_suppkey % 2 = 1 THEN 'failed' ELSE 'parsed' END AS status
  FROM a0)
"""


def alert_oracle(name: str, body: str) -> None:
    ORACLES[name] = ALERT_CTE + body


alert_oracle("parse_alerts", """
SELECT message_id AS source, status,
       CASE WHEN status = 'parsed' THEN l_shipdate END AS txn_date,
       CASE WHEN status = 'parsed' THEN CAST(amt AS DOUBLE) END AS amount,
       CASE WHEN status = 'failed' THEN NULL WHEN kind = 1 THEN p_name WHEN kind = 2 THEN upper(p_name)
            WHEN kind = 3 THEN vpa_name ELSE 'Unknown' END AS merchant,
       CASE WHEN status = 'failed' THEN NULL WHEN kind = 1 THEN 'UPI' WHEN kind = 2 THEN 'CREDIT CARD'
            WHEN kind = 3 THEN 'UPI' ELSE 'NEFT' END AS payment_method,
       bank_name
FROM alerts
""")

alert_oracle("extract_amount", "SELECT message_id, CAST(amt AS DOUBLE) AS amount FROM alerts")

alert_oracle("extract_merchant", """
SELECT message_id, CASE kind WHEN 1 THEN p_name WHEN 2 THEN upper(p_name) || ' INMUMBAI'
                             WHEN 3 THEN 'VPA ' || replace(p_name, ' ', '.') END AS merchant
FROM alerts
""")

alert_oracle("extract_vpa", """
SELECT message_id, CASE WHEN kind = 3 THEN replace(p_name, ' ', '.') || '@okaxis' END AS vpa FROM alerts
""")

alert_oracle("extract_payment_method", """
SELECT message_id, CASE kind WHEN 1 THEN 'UPI' WHEN 2 THEN 'CREDIT CARD' WHEN 3 THEN 'UPI' ELSE 'NEFT' END
       AS payment_method
FROM alerts
""")

alert_oracle("extract_txn_date", "SELECT message_id, l_shipdate AS txn_date FROM alerts")

alert_oracle("clean_merchant", """
SELECT message_id,
       CASE kind WHEN 1 THEN p_name WHEN 2 THEN upper(p_name) || ' INMUMBAI'
                 WHEN 3 THEN 'VPA ' || replace(p_name, ' ', '.') END AS phrase,
       CASE kind WHEN 1 THEN p_name WHEN 2 THEN upper(p_name)
                 WHEN 3 THEN 'VPA ' || replace(p_name, ' ', '.') END AS merchant
FROM alerts
""")

alert_oracle("clean_vpa", """
SELECT message_id, replace(p_name, ' ', '.') || '@okaxis' AS vpa, vpa_name AS merchant
FROM alerts WHERE kind = 3
""")

ORACLES["parse_date"] = """
WITH d AS (
  SELECT o_orderkey, CASE o_orderkey % 8
    WHEN 0 THEN CAST(day(o_orderdate) AS VARCHAR) || '/' || CAST(month(o_orderdate) AS VARCHAR) || '/'
                || strftime(o_orderdate, '%Y')
    WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y')
    WHEN 2 THEN strftime(o_orderdate, '%d/%m/%y')
    WHEN 3 THEN CAST(day(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) || '-'
                || strftime(o_orderdate, '%y')
    WHEN 4 THEN upper(CAST(day(o_orderdate) AS VARCHAR) || ' ' || strftime(o_orderdate, '%B %Y'))
    WHEN 5 THEN strftime(o_orderdate, '%d  %b %Y')
    WHEN 6 THEN '31/02/' || strftime(o_orderdate, '%Y')
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_text
  FROM orders)
SELECT o_orderkey, date_text,
       CAST(COALESCE(
         CASE WHEN regexp_full_match(trim(date_text), '\\d{1,2}/\\d{1,2}/\\d{4}') THEN try_strptime(trim(date_text), '%d/%m/%Y') END,
         CASE WHEN regexp_full_match(trim(date_text), '\\d{1,2}-\\d{1,2}-\\d{4}') THEN try_strptime(trim(date_text), '%d-%m-%Y') END,
         CASE WHEN regexp_full_match(trim(date_text), '\\d{1,2}/\\d{1,2}/\\d{2}') THEN try_strptime(trim(date_text), '%d/%m/%y') END,
         CASE WHEN regexp_full_match(trim(date_text), '\\d{1,2}-\\d{1,2}-\\d{2}') THEN try_strptime(trim(date_text), '%d-%m-%y') END,
         CASE WHEN regexp_full_match(trim(date_text), '\\d{1,2}\\s+[A-Za-z]+\\s+\\d{4}') THEN try_strptime(trim(date_text), '%d %B %Y') END,
         CASE WHEN regexp_full_match(trim(date_text), '\\d{1,2}\\s+[A-Za-z]+\\s+\\d{4}') THEN try_strptime(trim(date_text), '%d %b %Y') END)
            AS TIMESTAMP) AS parsed
FROM d
"""

ORACLES["parse_amount"] = """
WITH a AS (
  SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS p, o_orderkey % 5 AS k FROM orders),
t AS (
  SELECT o_orderkey, CASE k WHEN 0 THEN format('{:,.2f}', p) WHEN 1 THEN ' ' || CAST(p AS VARCHAR) || ' '
                            WHEN 2 THEN CAST(-p AS VARCHAR) WHEN 3 THEN CAST(p * 100 AS VARCHAR)
                            ELSE CAST(p AS VARCHAR) || 'x' END AS amount_text
  FROM a),
v AS (SELECT o_orderkey, amount_text, TRY_CAST(trim(replace(amount_text, ',', '')) AS DOUBLE) AS x FROM t)
SELECT o_orderkey, amount_text, CASE WHEN x > 0 AND x <= 10000000 THEN ROUND(x, 2) END AS amount FROM v
"""

_TXN_KEYWORDS = ["debited", "credited", "upi txn", "rs.", "inr", "a/c", "account"]
ORACLES["is_transaction_message"] = (
    "SELECT doc_id, (" + " + ".join(f"CAST(contains(lower(text), '{k}') AS INTEGER)" for k in _TXN_KEYWORDS)
    + f") >= 2 AS is_txn FROM {DOCUMENTS}"
)

alert_oracle("decode_mime_body", """
SELECT message_id AS id,
       CASE WHEN l_linenumber % 4 = 3 THEN '<html><body><p>' || text || '</p></body></html>' ELSE text END AS body
FROM alerts
""")

alert_oracle("message_records", """
SELECT 'gmail' AS source, message_id, ts_ms AS timestamp, text AS raw_text, bank_name
FROM alerts WHERE kind <> 2
""")

alert_oracle("resolve_bank", """
SELECT message_id AS id,
       CASE l_suppkey % 3 WHEN 0 THEN 'HDFC Bank InstaAlerts <alerts@hdfcbank.bank.in>'
                          WHEN 1 THEN 'SBI <cbsalerts@sbi.co.in>'
                          ELSE 'Axis Bank Alerts <alerts@axis.bank.in>' END AS sender,
       bank_name
FROM alerts
""")

ORACLES["html_to_text"] = r"""
WITH s1 AS (
  SELECT page_id, html,
         regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'),
                        '(?:<[^>]*>)+', ' ', 'g') AS t
  FROM pages),
s2 AS (SELECT page_id, html, ~ENTITIES~ AS t FROM s1)
SELECT page_id, CASE WHEN contains(lower(html), '<html') THEN regexp_replace(t, '^\s+|\s+$', '', 'g') ELSE html END
       AS text
FROM s2
"""

alert_oracle("mail_query_filter", """
SELECT message_id AS id, ts_ms AS internalDate FROM alerts
WHERE ts_ms >= epoch_ms(TIMESTAMP '1998-08-02 10:30:00') - 2592000000
  AND ts_ms <= epoch_ms(TIMESTAMP '1998-08-02 10:30:00')
""")

alert_oracle("mail_latest_n", """
SELECT message_id AS id, ts_ms AS internalDate FROM alerts ORDER BY ts_ms DESC, message_id ASC LIMIT 100
""")


# --- merchant rules, generated from the fixture rules ----------------------------------

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rules_oracles() -> None:
    from ledgerlens import constants as K
    from ledgerlens.plans.fixtures import ordered_rules

    rules = ordered_rules()
    all_txn = ("SELECT 'expenses' AS table_name, * FROM expenses "
               "UNION ALL SELECT 'credits' AS table_name, * FROM credits")
    key = "lower(COALESCE(merchant, ''))"
    first = "CASE " + " ".join(f"WHEN contains({key}, {_q(r[1])}) THEN {i}" for i, r in enumerate(rules)) + " END"
    pick = lambda field: "CASE r " + " ".join(f"WHEN {i} THEN {_q(r[field])}" for i, r in enumerate(rules)) + " END"
    fb = "CASE " + " ".join(f"WHEN contains({key}, {_q(k.lower())}) THEN {i}"
                            for i, (k, _, _) in enumerate(K.CATEGORY_MAP)) + " END"
    fb_pick = lambda j: "CASE f " + " ".join(f"WHEN {i} THEN {_q(e[j])}"
                                            for i, e in enumerate(K.CATEGORY_MAP)) + " END"

    def categorize_sql(with_rules: bool) -> str:
        r_expr = first if with_rules else "CAST(NULL AS INTEGER)"
        return TXN_CTE + f"""
, base AS (SELECT table_name, source, merchant, {r_expr} AS r, {fb} AS f FROM ({all_txn}) t),
dec AS (
  SELECT table_name, source, merchant, r, f,
         {pick(2) if with_rules else 'CAST(NULL AS VARCHAR)'} AS clean,
         COALESCE({pick(3) if with_rules else 'CAST(NULL AS VARCHAR)'}, 'Other') AS cat1,
         CASE WHEN r IS NOT NULL THEN {pick(4) if with_rules else "''"} ELSE '' END AS sub1
  FROM base)
SELECT table_name, source,
       CASE WHEN clean IS NOT NULL AND clean <> '' THEN clean ELSE merchant END AS merchant,
       CASE WHEN cat1 = 'Other' AND f IS NOT NULL THEN {fb_pick(1)} ELSE cat1 END AS category,
       CASE WHEN cat1 = 'Other' AND f IS NOT NULL THEN {fb_pick(2)} ELSE sub1 END AS sub_category
FROM dec
"""

    ORACLES["categorize_mappings"] = categorize_sql(True)
    ORACLES["categorize_fallback"] = categorize_sql(False)

    steps = [f", s0 AS (SELECT table_name, source, merchant AS m, category AS c, sub_category AS s, "
             f"0 AS n_hits, {', '.join(f'0 AS h{i}' for i in range(len(rules)))} FROM ({all_txn}) t)"]
    for i, r in enumerate(rules):
        cond = f"(m IS NOT NULL AND lower(m) LIKE {_q('%' + r[1] + '%')})"
        hs = ", ".join(f"CASE WHEN {cond} THEN 1 ELSE 0 END AS h{j}" if j == i else f"h{j}" for j in range(len(rules)))
        steps.append(
            f", s{i + 1} AS (SELECT table_name, source, CASE WHEN {cond} THEN {_q(r[2])} ELSE m END AS m, "
            f"CASE WHEN {cond} THEN {_q(r[3])} ELSE c END AS c, CASE WHEN {cond} THEN {_q(r[4])} ELSE s END AS s, "
            f"n_hits + CASE WHEN {cond} THEN 1 ELSE 0 END AS n_hits, {hs} FROM s{i})")
    chain = TXN_CTE + "\n".join(steps)
    last = f"s{len(rules)}"
    ORACLES["apply_mappings"] = chain + (
        f"\nSELECT table_name, source, m AS merchant, c AS category, s AS sub_category, n_hits FROM {last}")
    report = " UNION ALL ".join(
        f"SELECT {_q(r[1])} AS pattern, {i} AS rule_order, "
        f"SUM(CASE WHEN table_name = 'expenses' THEN h{i} ELSE 0 END) AS expenses, "
        f"SUM(CASE WHEN table_name = 'credits' THEN h{i} ELSE 0 END) AS credits FROM {last}"
        for i, r in enumerate(rules))
    ORACLES["apply_report"] = chain + f"\nSELECT * FROM ({report}) x WHERE expenses + credits > 0"


_rules_oracles()


# --- store, mappings, search, questions, documents ------------------------------------------

BOTH_CTE = TXN_CTE + ALERT_CTE.replace("WITH li AS", ", li AS", 1)

ORACLES["dedup_against_store"] = BOTH_CTE + """
, parsed AS (
  SELECT message_id AS source, l_shipdate AS txn_date, CAST(amt AS DOUBLE) AS amount,
         CASE kind WHEN 1 THEN p_name WHEN 2 THEN upper(p_name) WHEN 3 THEN vpa_name ELSE 'Unknown' END AS merchant,
         ROW_NUMBER() OVER (PARTITION BY message_id ORDER BY text, l_shipdate) AS rn
  FROM alerts WHERE status = 'parsed')
SELECT source, txn_date, amount, merchant FROM parsed
WHERE rn = 1 AND source NOT IN (SELECT source FROM txn WHERE txn_type = 'debit'
                                AND txn_date < TIMESTAMP '1995-01-01 00:00:00')
"""

oracle("append_transactions", """
SELECT source, txn_type, txn_date, CAST(amount AS DOUBLE) AS amount, 'INR' AS currency, merchant FROM txn
""")

ORACLES["publish_bi_views"] = ORACLES["top_merchants"]

oracle("delete_bad_rows", """
SELECT source, CAST(amount AS DOUBLE) AS amount FROM expenses
WHERE NOT COALESCE(amount > 10000000 OR merchant IN ('the', 'a', 'an'), false)
""")

oracle("maintained_views", """
, kept AS (
  SELECT * FROM expenses WHERE NOT COALESCE(amount > 10000000 OR merchant IN ('the', 'a', 'an'), false)),
per_category AS (
  SELECT COALESCE(category, 'Other') AS name, COUNT(*) AS n, SUM(amount) AS spent FROM kept GROUP BY 1),
top AS (
  SELECT merchant, SUM(amount) AS spent, COUNT(*) AS n FROM kept WHERE merchant IS NOT NULL
  GROUP BY 1 ORDER BY spent DESC, merchant ASC LIMIT 20),
both_sides AS (
  SELECT txn_date, amount AS spent, 0 AS earned FROM kept
  UNION ALL SELECT txn_date, 0, amount FROM txn WHERE txn_type = 'credit')
SELECT 'monthly_spend' AS view, CAST(CAST(date_trunc('month', txn_date) AS DATE) AS VARCHAR) AS key,
       CAST(SUM(amount) AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS further, COUNT(*) AS n FROM kept GROUP BY 2
UNION ALL
SELECT 'category_spend', name, CAST(spent AS DOUBLE), CAST(ROW_NUMBER() OVER (ORDER BY spent DESC, name) AS DOUBLE), n FROM per_category
UNION ALL
SELECT 'top_merchants', merchant, CAST(spent AS DOUBLE), ROUND(CAST(spent AS DOUBLE) / n, 6), n FROM top
UNION ALL
SELECT 'income_vs_expense', CAST(CAST(date_trunc('month', txn_date) AS DATE) AS VARCHAR),
       CAST(SUM(earned) AS DOUBLE), CAST(SUM(earned) - SUM(spent) AS DOUBLE), NULL FROM both_sides GROUP BY 2
""")

_CAP = "upper(substr({x}, 1, 1)) || lower(substr({x}, 2))"
# two-word names (adjective noun) and one-word types
_INITCAP2 = ("upper(substr(split_part({x}, ' ', 1), 1, 1)) || lower(substr(split_part({x}, ' ', 1), 2)) || ' ' || "
             "upper(substr(split_part({x}, ' ', 2), 1, 1)) || lower(substr(split_part({x}, ' ', 2), 2))")
_CSV_ROWS = f"""
, names AS (SELECT p_name, min(p_type) AS t, min(p_brand) AS b FROM part GROUP BY p_name),
csv AS (
  SELECT p_name AS raw_pattern, {_INITCAP2.format(x='p_name')} AS clean_name,
         CASE WHEN starts_with(p_name, 'hot') THEN '' ELSE {_CAP.format(x='t')} END AS category,
         b AS sub_category,
         CASE WHEN starts_with(p_name, 'cold') THEN NULL ELSE length(p_name) % 7 END AS priority,
         CASE WHEN starts_with(p_name, 'hot') THEN 'skipped_missing'
              WHEN starts_with(p_name, 'cold') THEN 'skipped_priority' ELSE 'ok' END AS status
  FROM names)
"""

ORACLES["read_mapping_csv"] = "WITH x AS (SELECT 1)" + _CSV_ROWS + \
    "SELECT raw_pattern, clean_name, category, sub_category, CAST(priority AS INTEGER) AS priority, status FROM csv"


def _upsert_sql() -> str:
    from ledgerlens.plans.fixtures import TEST_RULES

    vals = ", ".join(f"({i}, {_q(p)}, {_q(c)}, {_q(cat)}, {_q(sub)}, {pri})" for i, p, c, cat, sub, pri in TEST_RULES)
    return "WITH x AS (SELECT 1)" + _CSV_ROWS + f"""
, ex(id, raw_pattern, clean_name, category, sub_category, priority) AS (VALUES {vals}),
inc AS (SELECT * FROM csv WHERE status = 'ok'),
j AS (
  SELECT COALESCE(ex.raw_pattern, inc.raw_pattern) AS raw_pattern, ex.id AS old_id,
         COALESCE(inc.clean_name, ex.clean_name) AS clean_name, COALESCE(inc.category, ex.category) AS category,
         COALESCE(inc.sub_category, ex.sub_category) AS sub_category,
         CAST(COALESCE(inc.priority, ex.priority) AS INTEGER) AS priority
  FROM ex FULL OUTER JOIN inc ON ex.raw_pattern = inc.raw_pattern),
u AS (
  SELECT CAST(COALESCE(old_id, {len(TEST_RULES)} + ROW_NUMBER() OVER (PARTITION BY old_id IS NULL ORDER BY raw_pattern))
              AS INTEGER) AS id, raw_pattern, clean_name, category, sub_category, priority
  FROM j)
"""


def _q(s: str) -> str:  # noqa: F811 - same helper, defined before use here
    return "'" + s.replace("'", "''") + "'"


ORACLES["upsert_mappings"] = _upsert_sql() + "SELECT * FROM u"
ORACLES["lookup_mapping"] = _upsert_sql() + "SELECT id, raw_pattern, clean_name FROM u WHERE raw_pattern = 'blue widget'"
ORACLES["delete_mapping"] = _upsert_sql() + "SELECT id, raw_pattern, true AS existed FROM u WHERE raw_pattern <> 'gear'"

_RECLEAN = """
, r AS (
  SELECT message_id AS source,
         CASE kind WHEN 1 THEN p_name WHEN 2 THEN upper(p_name) || ' INMUMBAI'
                   WHEN 3 THEN replace(p_name, ' ', '.') || '@okaxis' END AS old_merchant,
         CASE kind WHEN 1 THEN p_name WHEN 2 THEN upper(p_name) WHEN 3 THEN vpa_name END AS merchant,
         CASE kind WHEN 1 THEN 'unchanged' WHEN 2 THEN 'cleaned' WHEN 3 THEN 'cleaned' END AS change
  FROM alerts)
"""
alert_oracle("reclean_existing", _RECLEAN + "SELECT * FROM r")
alert_oracle("reclean_counts", _RECLEAN + "SELECT change, COUNT(*) AS n FROM r WHERE change IS NOT NULL GROUP BY change")

_QVEC = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)"
ORACLES["semantic_search"] = f"""
SELECT vec_id, label, ROUND(list_distance(CAST(embedding AS DOUBLE[]), {_QVEC}), 4) AS distance
FROM embeddings WHERE embedding IS NOT NULL
ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_QVEC}) ASC, vec_id ASC LIMIT 5
"""
ORACLES["semantic_search_unfiltered"] = f"""
SELECT vec_id, label FROM embeddings
ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_QVEC}) ASC NULLS LAST, vec_id ASC LIMIT 5
"""
ORACLES["semantic_search_batch"] = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT label, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM e),
c AS (SELECT label, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY label, i) t GROUP BY label),
d AS (SELECT c.label AS query_id, e.vec_id, list_distance(e.v, c.q) AS distance FROM e, c),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, ROUND(distance, 4) AS distance FROM r WHERE rank <= 5
"""
oracle("embed_transactions", "SELECT source, 64 AS dims, 1.0 AS norm FROM txn")

_QUESTIONS = r"""
, q AS (SELECT conv_id * 1000 + turn AS question_id, lower(text) AS t FROM ~CONV~ WHERE role = 'user'),
w AS (SELECT *, string_split_regex(regexp_replace(t, '^\s+|\s+$', '', 'g'), '\s+') AS words FROM q),
f AS (
  SELECT question_id,
         CASE WHEN len(words) > 1 THEN words[-1] END AS merchant,
         CASE WHEN contains(t, 'today') THEN TIMESTAMP '1998-08-02 00:00:00'
              WHEN contains(t, 'yesterday') THEN TIMESTAMP '1998-08-01 00:00:00'
              WHEN contains(t, 'week') THEN TIMESTAMP '1998-07-26 10:30:00'
              WHEN contains(t, 'month') THEN TIMESTAMP '1998-07-03 10:30:00' END AS start_date,
         CASE WHEN NOT contains(t, 'today') AND contains(t, 'yesterday') THEN TIMESTAMP '1998-08-02 00:00:00'
              END AS end_date,
         CASE WHEN contains(t, 'travel') THEN 'travel' WHEN contains(t, 'transport') THEN 'transport'
              WHEN contains(t, 'shopping') THEN 'shopping' WHEN contains(t, 'food') THEN 'food' END AS category,
         CASE WHEN contains(t, 'upi') THEN 'upi' END AS payment_method
  FROM w)
"""
ORACLES["interpret_question"] = "WITH x AS (SELECT 1)" + _QUESTIONS + "SELECT * FROM f"
_TOTALS = """
SELECT f.question_id, CAST(COALESCE(SUM(e.amount), 0) AS DOUBLE) AS total
FROM f LEFT JOIN expenses e
  ON (f.merchant IS NULL OR e.merchant ILIKE '%' || f.merchant || '%')
 AND (f.category IS NULL OR e.category ILIKE '%' || f.category || '%')
 AND (f.payment_method IS NULL OR e.payment_method ILIKE '%' || f.payment_method || '%')
 AND (f.start_date IS NULL OR e.txn_date >= f.start_date)
 AND (f.end_date IS NULL OR e.txn_date <= f.end_date)
GROUP BY f.question_id
"""
oracle("answer_questions", _QUESTIONS + _TOTALS)


def _any_contains(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {_q(w)})" for w in words) + ")"


def _question_oracles() -> None:
    from ledgerlens import constants as K

    ORACLES["route_questions"] = (
        "SELECT conv_id * 1000 + turn AS question_id, CASE WHEN "
        + _any_contains("lower(text)", K.STRUCTURED_KEYWORDS)
        + f" THEN 'sql' ELSE 'semantic' END AS route FROM {CONVERSATIONS} WHERE role = 'user'")
    ORACLES["is_structured_question"] = (
        "SELECT conv_id, turn, " + _any_contains("lower(text)", K.STRUCTURED_KEYWORDS)
        + f" AS structured FROM {CONVERSATIONS}")
    ORACLES["is_safe_select"] = (
        r"WITH c AS (SELECT conv_id, turn, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS q FROM ~CONV~) " +
        "SELECT conv_id, turn, starts_with(q, 'select') AND NOT " + _any_contains("q", K.SQL_FORBIDDEN)
        + " AS safe FROM c")
    ORACLES["redact_pii"] = "SELECT doc_id, " + _redact_chain(K.PII_RULES) + f" AS text FROM {DOCUMENTS}"


def _redact_chain(rules) -> str:
    expr = "text"
    for pattern, repl in rules:
        expr = f"regexp_replace({expr}, {_q(pattern)}, {_q(repl)}, 'g')"
    return expr


_question_oracles()


def _answer_routed() -> str:
    """Totals of structured questions; for the others the nearest transactions by hashed-token vectors.

    A token's place is its 32-bit Murmur3 hash (seed 42) modulo 64; vectors are counts over their length, in single precision.
    """
    def times(a: str, b: int) -> str:
        return f"(({a})::HUGEINT * {b} % 4294967296)::BIGINT"

    def let(value: str, body: str) -> str:  # body of x
        return f"list_transform([{value}], lambda x: {body})[1]"

    def rotl(value: str, n: int) -> str:
        return let(value, f"x * {1 << n} % 4294967296 + x // {1 << 32 - n}")

    def mixed(k: str) -> str:
        return times(rotl(times(k, 0xCC9E2D51), 15), 0x1B873593)

    byte = "(strpos('0123456789ABCDEF', substr(h, 2 * ({i}) + 1, 1)) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * ({i}) + 2, 1)) - 17)::BIGINT"
    word = " + ".join(f"{byte.replace('{i}', f'4 * b + {k}')} * {256 ** k}" for k in range(4))
    tail = " + ".join(f"CASE WHEN n % 4 > {k} THEN {byte.replace('{i}', f'n // 4 * 4 + {k}')} * {256 ** k} ELSE 0 END" for k in range(3))
    return ALERT_CTE.rstrip() + "," + TXN_CTE.strip()[5:] + _QUESTIONS.replace("~CONV~", CONVERSATIONS) + f"""
, routes AS (""" + ORACLES["route_questions"] + f"""),
totals AS (""" + _TOTALS + f"""),
texts AS (
  SELECT 'q' AS side, NULL::VARCHAR AS source, question_id AS id, t AS body FROM q JOIN routes USING (question_id) WHERE route = 'semantic'
  UNION ALL
  SELECT 't', message_id, row_number() OVER (), lower(array_to_string(list_filter([
      CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 5 AND day(l_shipdate) = 1 THEN 'City Rent'
        WHEN l_linenumber = 6 AND l_suppkey % 4 = 2 THEN 'the' WHEN l_linenumber = 6 AND l_suppkey % 4 = 0 THEN ''
        WHEN l_linenumber = 6 AND l_suppkey % 4 = 1 THEN 'Unknown' ELSE p_name END,
      CASE p_type WHEN 'STANDARD' THEN NULL WHEN 'PROMO' THEN 'Other' ELSE p_type END,
      CASE kind WHEN 0 THEN 'UPI' WHEN 1 THEN 'CREDIT CARD' WHEN 2 THEN 'NEFT' END, text], lambda p: p IS NOT NULL AND p <> ''), ' '))
  FROM alerts WHERE l_returnflag <> 'R'),
tokens AS (SELECT side, id, unnest(list_filter(string_split_regex(body, '[^\\p{{L}}\\p{{N}}]+'), lambda p: p <> '')) AS w FROM texts),
hex AS (SELECT w, hex(encode(w)) AS h, strlen(w) AS n FROM (SELECT DISTINCT w FROM tokens)),
m1 AS (SELECT *, list_reduce(list_prepend(42::BIGINT, list_transform(range(n // 4), lambda b: {mixed(word)})),
  lambda g, k: ({times(rotl('xor(g, k)', 13), 5)} + 3864292196) % 4294967296) AS g FROM hex),
m2 AS (SELECT w, n, CASE WHEN n % 4 > 0 THEN xor(g, {mixed(tail)}) ELSE g END AS g FROM m1),
m3 AS (SELECT w, {times(let('xor(g, n::BIGINT)', 'xor(x, x // 65536)'), 0x85EBCA6B)} AS g FROM m2),
m4 AS (SELECT w, {times('xor(g, g // 8192)', 0xC2B2AE35)} AS g FROM m3),
places AS (SELECT w, xor(g, g // 65536) % 64 AS i FROM m4),
counts AS (SELECT side, id, i, COUNT(*) AS c FROM tokens JOIN places USING (w) GROUP BY ALL),
sized AS (SELECT *, CAST(c / sqrt(SUM(c * c) OVER (PARTITION BY side, id)) AS FLOAT)::DOUBLE AS x FROM counts),
spread AS (SELECT side, source, id, unnest(range(64)) AS i FROM texts),
vectors AS (SELECT s.side, s.source, s.id, list(coalesce(x, 0) ORDER BY s.i) AS v
  FROM spread s LEFT JOIN sized z ON z.side = s.side AND z.i = s.i AND z.id = s.id
  GROUP BY ALL),
near AS (SELECT q.id AS question_id, t.source, ROUND(list_distance(q.v, t.v), 9) AS d FROM vectors q, vectors t WHERE q.side = 'q' AND t.side = 't'
  QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY d, t.source) <= 5),
found AS (SELECT question_id, list(source ORDER BY d, source) AS matches FROM near GROUP BY question_id)
SELECT r.question_id, r.route, CASE WHEN r.route = 'sql' THEN totals.total END AS total, matches
FROM routes r LEFT JOIN totals ON totals.question_id = r.question_id LEFT JOIN found ON found.question_id = r.question_id
"""


oracle("guarded_sql", "SELECT category, CAST(SUM(amount) AS DOUBLE) AS total FROM expenses GROUP BY category")

ORACLES["strip_code_fence"] = r"""
SELECT conv_id, turn, regexp_replace(regexp_replace(text, '```(?:sql)?', '', 'g'), '^\s+|\s+$', '', 'g') AS sql
FROM ~CONV~
"""

alert_oracle("suggest_pattern", """
, s AS (SELECT message_id, lower(text) AS lt, p_name, w1, w2 FROM alerts)
SELECT message_id,
  CASE WHEN contains(lt, p_name) THEN p_name
       WHEN length(w2) > length(w1) THEN
            CASE WHEN length(w2) > 3 AND contains(lt, w2) THEN w2 WHEN length(w1) > 3 AND contains(lt, w1) THEN w1 END
       ELSE CASE WHEN length(w1) > 3 AND contains(lt, w1) THEN w1 WHEN length(w2) > 3 AND contains(lt, w2) THEN w2 END
  END AS pattern
FROM s
""")

ORACLES["row_hash"] = """
SELECT doc_id, substr(sha256(text), 1, 16) AS row_hash,
       'pdf:doc-' || CAST(doc_id AS VARCHAR) || ':' || substr(sha256(text), 1, 16) AS source
FROM ~DOCS~
"""

ORACLES["embedding_text"] = ALERT_CTE + """
SELECT message_id AS source,
       concat_ws(' ',
         NULLIF(CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 5 AND day(l_shipdate) = 1 THEN 'City Rent'
                     WHEN l_linenumber = 6 AND l_suppkey % 4 = 2 THEN 'the'
                     WHEN l_linenumber = 6 AND l_suppkey % 4 = 0 THEN ''
                     WHEN l_linenumber = 6 AND l_suppkey % 4 = 1 THEN 'Unknown' ELSE p_name END, ''),
         NULLIF(CASE p_type WHEN 'STANDARD' THEN NULL WHEN 'PROMO' THEN 'Other' ELSE p_type END, ''),
         NULLIF(CASE l_linenumber % 4 WHEN 0 THEN 'UPI' WHEN 1 THEN 'CREDIT CARD' WHEN 2 THEN 'NEFT' ELSE '' END, ''),
         NULLIF(text, '')) AS text
FROM alerts
"""


# --- statements rendered from orders x lineitem x part -----------------------------------------

_ITEMS = """
WITH it AS (
  SELECT 'acct-' || CAST(o_custkey AS VARCHAR) AS doc, o_custkey, CAST(o_custkey % 5 AS INTEGER) AS fmt,
         l_orderkey, l_linenumber AS ln, l_returnflag, l_shipdate, p_name,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS amt, CAST(year(o_orderdate) - 1992 AS INTEGER) AS table_no,
         l_orderkey * 8 + l_linenumber AS row_no
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
"""

ORACLES["read_statement_tables"] = _ITEMS + """
SELECT doc, table_no, CAST(0 AS BIGINT) AS row_no, CASE fmt WHEN 0 THEN 7 WHEN 1 THEN 6 WHEN 2 THEN 7 ELSE 1 END AS n_cells
FROM (SELECT DISTINCT doc, table_no, fmt FROM it WHERE fmt < 4) h
UNION ALL
SELECT doc, table_no, row_no, CASE fmt WHEN 0 THEN 7 WHEN 1 THEN 6 WHEN 2 THEN 7 ELSE 1 END FROM it WHERE fmt < 4
"""

ORACLES["detect_statement_format"] = _ITEMS + """
SELECT doc, CASE any_value(fmt) WHEN 0 THEN 'axis' WHEN 1 THEN 'hdfc' WHEN 2 THEN 'sbi' WHEN 3 THEN 'card_cell'
                 ELSE 'card_text' END AS format,
       CASE WHEN any_value(fmt) < 3 THEN CAST(min(table_no) AS INTEGER) END AS start_table
FROM it GROUP BY doc
"""

ORACLES["statement_rows_multicol"] = _ITEMS + """
, r AS (
  SELECT *, CASE WHEN ln = 5 THEN 'Opening Balance' ELSE strftime(l_shipdate, '%d/%m/%Y') END AS d,
         CASE WHEN ln = 3 THEN upper(p_name) || ' MUMBAI'
              ELSE upper(p_name) || ' ' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') END AS descr,
         format('{:,.2f}', amt) AS a, 'REF' || CAST(l_orderkey AS VARCHAR) AS ref
  FROM it WHERE fmt IN (0, 1, 2)),
c AS (
  SELECT *, CASE WHEN ln = 6 THEN NULL WHEN ln = 7 THEN a WHEN l_returnflag <> 'R' THEN a END AS debit,
            CASE WHEN ln = 6 THEN NULL WHEN ln = 7 THEN '1.00' WHEN l_returnflag = 'R' THEN a END AS credit
  FROM r),
j AS (
  SELECT *, CASE fmt WHEN 0 THEN concat_ws(' | ', d, descr, 'BR01', debit, credit)
                     WHEN 1 THEN concat_ws(' | ', d, descr, ref, debit, credit)
                     ELSE concat_ws(' | ', d, d, descr, ref, debit, credit) END AS raw
  FROM c)
SELECT doc, 'pdf:' || doc || ':' || substr(sha256(raw), 1, 16) AS source, l_shipdate AS txn_date,
       CAST(amt AS DOUBLE) AS amount,
       CASE WHEN ln = 7 OR l_returnflag <> 'R' THEN 'debit' ELSE 'credit' END AS txn_type,
       upper(p_name) AS merchant, CASE fmt WHEN 0 THEN 'AXIS' WHEN 1 THEN 'HDFC' ELSE 'SBI' END AS bank_name
FROM j WHERE ln NOT IN (5, 6)
"""

ORACLES["statement_rows_card_cell"] = _ITEMS + """
, c AS (
  SELECT *, strftime(l_shipdate, '%d/%m/%Y') || '| 10:30 ' || upper(p_name)
            || CASE WHEN l_returnflag = 'R' THEN ' + C ' ELSE ' C ' END || format('{:,.2f}', amt) || ' l' AS cell
  FROM it WHERE fmt = 3 AND ln NOT IN (5, 6))
SELECT doc, 'pdf:' || doc || ':' || substr(sha256(cell), 1, 16) AS source, l_shipdate AS txn_date,
       CAST(amt AS DOUBLE) AS amount, CASE WHEN l_returnflag = 'R' THEN 'credit' ELSE 'debit' END AS txn_type,
       upper(p_name) AS merchant, 'HDFC' AS bank_name
FROM c
"""

_CARD_TEXT = _ITEMS + """
, docs AS (SELECT DISTINCT doc, o_custkey, 1995 + o_custkey % 4 AS yr, CAST(o_custkey % 12 + 1 AS INTEGER) AS end_month
           FROM it WHERE fmt = 4),
tx AS (
  SELECT it.doc, row_no AS page_no, month(l_shipdate) AS m, strftime(l_shipdate, '%B') AS month_str,
         CAST(day(l_shipdate) AS VARCHAR) AS day_str,
         CASE WHEN l_returnflag = 'R' THEN 'PAYMENT RECEIVED ' || upper(p_name) ELSE upper(p_name) END AS descr,
         upper(p_name) AS base, format('{:,.2f}', amt) AS amt_str, amt
  FROM it WHERE fmt = 4 AND ln NOT IN (5, 6)
  UNION ALL
  SELECT doc, 8000000000002, 1, 'January', '21', 'EMI INSURANCE PREMIUM', 'INSURANCE PREMIUM', '250.00',
         CAST(250 AS DECIMAL(12,2))
  FROM docs),
v AS (
  SELECT tx.*, try_strptime(CAST(CASE WHEN m > end_month THEN yr - 1 ELSE yr END AS VARCHAR) || '-' || CAST(m AS VARCHAR)
                            || '-' || day_str, '%Y-%m-%d') AS txn_date,
         month_str || ' ' || day_str || ' | ' || descr || ' | ' || amt_str AS raw_line
  FROM tx JOIN docs USING (doc)),
k AS (
  SELECT *, 'pdf:' || doc || ':' || substr(sha256(raw_line), 1, 16) AS source FROM v WHERE txn_date IS NOT NULL),
f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc, source ORDER BY page_no) AS rn FROM k)
"""

ORACLES["statement_lines_card_text"] = _CARD_TEXT + """
SELECT doc, source, CAST(txn_date AS TIMESTAMP) AS txn_date, CAST(amt AS DOUBLE) AS amount,
       CASE WHEN contains(descr, 'PAYMENT RECEIVED') THEN 'credit' ELSE 'debit' END AS txn_type,
       CASE WHEN starts_with(descr, 'PAYMENT RECEIVED') THEN descr ELSE base END AS merchant, 'AMEX' AS bank_name
FROM f WHERE rn = 1
"""

ORACLES["installment_section_flag"] = _ITEMS + """
SELECT DISTINCT doc, CAST(8000000000001 AS BIGINT) AS page_no, CAST(0 AS INTEGER) AS line_no FROM it WHERE fmt = 4
UNION ALL
SELECT DISTINCT doc, CAST(8000000000002 AS BIGINT), CAST(0 AS INTEGER) FROM it WHERE fmt = 4
"""

ORACLES["statement_year"] = _ITEMS + """
SELECT DISTINCT doc, CAST(1995 + o_custkey % 4 AS INTEGER) AS year, CAST(o_custkey % 12 + 1 AS INTEGER) AS end_month
FROM it WHERE fmt = 4
"""


# --- ingest pipelines -------------------------------------------------------------------------------

def _categorize_cols(m: str) -> tuple[str, str, str]:
    """SQL for (merchant, category, sub_category) after write-time rules on column ``m``."""
    from ledgerlens import constants as K
    from ledgerlens.plans.fixtures import ordered_rules

    rules = ordered_rules()
    key = f"lower(COALESCE({m}, ''))"

    def first_pick(i_field: int, default: str) -> str:
        return ("CASE " + " ".join(f"WHEN contains({key}, {_q(r[1])}) THEN {_q(r[i_field])}" for r in rules)
                + f" ELSE {default} END")

    matched = "(" + " OR ".join(f"contains({key}, {_q(r[1])})" for r in rules) + ")"
    fb_hit = "(" + " OR ".join(f"contains({key}, {_q(k.lower())})" for k, _, _ in K.CATEGORY_MAP) + ")"
    fb = lambda j: "CASE " + " ".join(f"WHEN contains({key}, {_q(e[0].lower())}) THEN {_q(e[j])}"
                                      for e in K.CATEGORY_MAP) + " END"
    clean = first_pick(2, "NULL")
    cat1 = first_pick(3, "'Other'")
    sub1 = first_pick(4, "''")
    merchant = f"CASE WHEN {clean} IS NOT NULL AND {clean} <> '' THEN {clean} ELSE {m} END"
    category = f"CASE WHEN {cat1} = 'Other' AND {fb_hit} THEN {fb(1)} ELSE {cat1} END"
    sub = f"CASE WHEN {cat1} = 'Other' AND {fb_hit} THEN {fb(2)} ELSE {sub1} END"
    _ = matched
    return merchant, category, sub


def _pipeline_oracles() -> None:
    m, c, s = _categorize_cols("merchant")
    ORACLES["alert_pipeline"] = BOTH_CTE + f"""
, msgs AS (
  SELECT message_id AS source, status, l_shipdate AS txn_date, text, bank_name,
         CAST(amt AS DOUBLE) AS amount,
         CASE kind WHEN 1 THEN p_name WHEN 3 THEN vpa_name ELSE 'Unknown' END AS merchant,
         CASE kind WHEN 1 THEN 'UPI' WHEN 3 THEN 'UPI' ELSE 'NEFT' END AS payment_method,
         ROW_NUMBER() OVER (PARTITION BY message_id ORDER BY l_shipdate, text) AS pos
  FROM alerts WHERE kind <> 2),
firsts AS (SELECT source, MIN(pos) FILTER (WHERE status = 'parsed') AS fp FROM msgs GROUP BY source),
saved AS (
  SELECT msgs.* FROM msgs JOIN firsts USING (source)
  WHERE pos = fp AND source NOT IN (SELECT source FROM txn WHERE txn_type = 'debit'
                                    AND txn_date < TIMESTAMP '1995-01-01 00:00:00'))
SELECT source, 'debit' AS txn_type, txn_date, amount, {m} AS merchant, {c} AS category, {s} AS sub_category,
       payment_method, bank_name
FROM saved
"""
    ORACLES["ingest_summary"] = BOTH_CTE + """
, msgs AS (
  SELECT message_id AS source, status, ROW_NUMBER() OVER (PARTITION BY message_id ORDER BY l_shipdate, text) AS pos
  FROM alerts WHERE kind <> 2),
stored AS (SELECT DISTINCT source FROM txn WHERE txn_type = 'debit' AND txn_date < TIMESTAMP '1995-01-01 00:00:00'),
k AS (SELECT source, MIN(pos) FILTER (WHERE status = 'parsed') AS fp FROM msgs GROUP BY source),
t AS (
  SELECT CASE WHEN s.source IS NOT NULL THEN 'skipped' WHEN k.fp IS NULL OR msgs.pos < k.fp THEN 'failed'
              WHEN msgs.pos = k.fp THEN 'saved' ELSE 'skipped' END AS st
  FROM msgs JOIN k USING (source) LEFT JOIN stored s USING (source))
SELECT COUNT(*) FILTER (WHERE st = 'saved') AS saved, COUNT(*) FILTER (WHERE st = 'skipped') AS skipped,
       COUNT(*) FILTER (WHERE st = 'failed') AS failed
FROM t
"""
    rows = " UNION ALL ".join(
        f"SELECT doc, source, txn_type, txn_date, amount, merchant, bank_name, "
        f"{pm} AS payment_method FROM ({ORACLES[k]}) x{i}"
        for i, (k, pm) in enumerate([("statement_rows_multicol", "''"), ("statement_rows_card_cell", "'CREDIT CARD'"),
                                     ("statement_lines_card_text", "'CREDIT CARD'")]))
    base = f"""
WITH allrows AS ({rows}),
stored AS (SELECT DISTINCT txn_type, source FROM allrows WHERE txn_date < TIMESTAMP '1995-01-01 00:00:00'),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY txn_type, source ORDER BY doc, txn_date) AS pos FROM allrows),
tagged AS (
  SELECT ranked.*, CASE WHEN s.source IS NOT NULL THEN 'skipped' WHEN pos = 1 THEN 'saved' ELSE 'skipped' END AS st
  FROM ranked LEFT JOIN stored s USING (txn_type, source))
"""
    ORACLES["statement_pipeline"] = base + f"""
SELECT source, txn_type, txn_date, amount, {m} AS merchant, {c} AS category, {s} AS sub_category,
       payment_method, bank_name
FROM tagged WHERE st = 'saved'
"""
    ORACLES["statement_ingest_summary"] = base + """
SELECT txn_type, COUNT(*) FILTER (WHERE st = 'saved') AS saved, COUNT(*) FILTER (WHERE st = 'skipped') AS skipped,
       CAST(0 AS BIGINT) AS failed
FROM tagged GROUP BY txn_type
"""


_pipeline_oracles()

ORACLES["inbox_stream"] = (
    "SELECT DISTINCT source, txn_type, txn_date, amount FROM ("
    f"SELECT source, txn_type, txn_date, amount FROM ({ORACLES['statement_rows_multicol']}) a "
    f"UNION ALL SELECT source, txn_type, txn_date, amount FROM ({ORACLES['statement_rows_card_cell']}) b "
    f"UNION ALL SELECT source, txn_type, CAST(txn_date AS TIMESTAMP), amount "
    f"FROM ({ORACLES['statement_lines_card_text']}) c) u"
)


# --- extensions ---------------------------------------------------------------------------------------

oracle("recurring_payments", """
, days AS (SELECT merchant, CAST(txn_date AS DATE) AS day, COUNT(*) AS n, SUM(amount) AS amt
           FROM expenses WHERE merchant IS NOT NULL GROUP BY 1, 2),
g AS (SELECT *, date_diff('day', LAG(day) OVER (PARTITION BY merchant ORDER BY day), day) AS gap FROM days),
s AS (SELECT merchant, SUM(n) AS n_charges, COUNT(gap) AS n_gaps, AVG(gap) AS avg_gap, STDDEV_POP(gap) AS sd_gap,
             CAST(SUM(amt) AS DOUBLE) / SUM(n) AS avg_amount, MAX(day) AS last_date
      FROM g GROUP BY merchant),
r AS (
  SELECT *, CASE WHEN avg_gap > 0 THEN sd_gap / avg_gap END AS cv,
         CASE WHEN avg_gap BETWEEN 5 AND 9 THEN 'weekly' WHEN avg_gap BETWEEN 12 AND 16 THEN 'biweekly'
              WHEN avg_gap BETWEEN 26 AND 35 THEN 'monthly' WHEN avg_gap BETWEEN 85 AND 100 THEN 'quarterly'
              WHEN avg_gap BETWEEN 350 AND 380 THEN 'annual' END AS period
  FROM s)
SELECT merchant, n_charges, n_gaps, ROUND(avg_gap, 4) AS avg_gap, ROUND(cv, 4) AS cv, period,
       ROUND(avg_amount, 2) AS avg_amount, last_date,
       CAST(last_date + CAST(ROUND(avg_gap) AS INTEGER) AS DATE) AS next_date,
       n_charges >= 3 AND period IS NOT NULL AND COALESCE(cv <= 0.35, false) AS is_recurring
FROM r
""")

oracle("budget_status", """
, b(category, monthly_limit) AS (VALUES ('ECONOMY', 5000000), ('LARGE', 1000000), ('SMALL', 20000000),
                                        ('MEDIUM', 3000000), ('Other', 100000), ('Travel', 1000)),
sp AS (SELECT COALESCE(category, 'Other') AS category, SUM(amount) AS spent FROM expenses
       WHERE txn_date >= TIMESTAMP '1998-07-01 00:00:00' AND txn_date <= TIMESTAMP '1998-07-20 12:00:00'
       GROUP BY 1),
j AS (SELECT b.category, CAST(b.monthly_limit AS DOUBLE) AS monthly_limit, CAST(COALESCE(sp.spent, 0) AS DOUBLE) AS spent
      FROM b LEFT JOIN sp USING (category))
SELECT category, monthly_limit, spent, ROUND(spent / monthly_limit * 100, 2) AS pct_used,
       CASE WHEN spent / monthly_limit >= 1 THEN 'exceeded' WHEN spent / monthly_limit >= 0.8 THEN 'warning'
            ELSE 'ok' END AS status
FROM j
""")


def _override_oracle() -> None:
    m, c, s = _categorize_cols("merchant")
    key = "lower(COALESCE(merchant, ''))"
    ORACLES["category_overrides"] = TXN_CTE + f"""
, t AS (SELECT 'expenses' AS table_name, * FROM expenses UNION ALL SELECT 'credits' AS table_name, * FROM credits)
SELECT table_name, source, {m} AS merchant,
       CASE {key} WHEN 'blue widget' THEN 'Gifts' WHEN 'red gear' THEN 'Auto' WHEN 'unknown' THEN 'Review'
            ELSE {c} END AS category,
       CASE {key} WHEN 'blue widget' THEN 'Toys' WHEN 'red gear' THEN '' WHEN 'unknown' THEN ''
            ELSE {s} END AS sub_category
FROM t
"""


_override_oracle()


_STMT_LINES = _ITEMS + """
, docs AS (SELECT DISTINCT doc, o_custkey FROM it WHERE fmt = 4),
hdr AS (
  SELECT doc, CAST(0 AS BIGINT) AS page_no, unnest([
      'American Express', 'Statement of Account',
      'Membership Number XXXX-XXXXXX-' || lpad(CAST(o_custkey AS VARCHAR), 5, '0'),
      'Statement period from December 10 to ' || strftime(make_date(2000, CAST(o_custkey % 12 + 1 AS INTEGER), 1), '%B')
        || ' 9',
      'Statement date 09/' || lpad(CAST(o_custkey % 12 + 1 AS VARCHAR), 2, '0') || '/' || CAST(1995 + o_custkey % 4 AS VARCHAR)
    ]) AS line,
    unnest(range(5)) AS line_no
  FROM docs),
tx AS (
  SELECT doc, row_no AS page_no, 0 AS line_no,
    CASE WHEN ln = 5 THEN 'Opening Balance ' || format('{:,.2f}', amt)
         WHEN ln = 6 THEN 'Page 2 of 5'
         ELSE strftime(l_shipdate, '%B') || ' ' || CAST(day(l_shipdate) AS VARCHAR) || ' '
              || CASE WHEN l_returnflag = 'R' THEN 'PAYMENT RECEIVED ' || upper(p_name) ELSE upper(p_name) END
              || CASE WHEN ln = 2 THEN ' ~~~~~' WHEN ln = 3 THEN ' 12.50' ELSE '' END
              || ' ' || format('{:,.2f}', amt) END AS line
  FROM it WHERE fmt = 4),
inst AS (
  SELECT doc, CAST(8000000000000 AS BIGINT) AS page_no, 0 AS line_no, 'Installment Plan Transactions' AS line FROM docs
  UNION ALL SELECT doc, CAST(8000000000001 AS BIGINT), 0, 'January 20 INSTALLMENT PRINCIPAL 3/12 1,000.00' FROM docs
  UNION ALL SELECT doc, CAST(8000000000002 AS BIGINT), 0, 'January 21 EMI INSURANCE PREMIUM 250.00' FROM docs),
lines AS (
  SELECT doc, page_no, CAST(line_no AS INTEGER) AS line_no, line FROM hdr
  UNION ALL SELECT doc, page_no, CAST(line_no AS INTEGER), line FROM tx
  UNION ALL SELECT doc, page_no, CAST(line_no AS INTEGER), line FROM inst)
"""

ORACLES["read_statement_text"] = _STMT_LINES + "SELECT doc, page_no, line_no, line FROM lines"
ORACLES["first_occurrence"] = _STMT_LINES + r"""
, k AS (SELECT doc, page_no, line_no,
               'pdf:' || doc || ':' || substr(sha256(regexp_replace(line, '^\s+|\s+$', '', 'g')), 1, 16) AS source
        FROM lines),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc, source ORDER BY page_no, line_no) AS rn FROM k)
SELECT doc, source, page_no, line_no FROM r WHERE rn = 1
"""


alert_oracle("read_messages", "SELECT message_id AS id, ts_ms AS internalDate, 2 AS n_headers FROM alerts")
oracle("category_rank", """
SELECT category, ROW_NUMBER() OVER (ORDER BY total_spent DESC, category ASC) AS row_id
FROM (SELECT COALESCE(category, 'Other') AS category, SUM(amount) AS total_spent FROM expenses GROUP BY 1) s
""")
ORACLES["mapping_order"] = _upsert_sql() + """
SELECT id, raw_pattern, priority, ROW_NUMBER() OVER (ORDER BY priority DESC, id ASC) AS position FROM u
"""
oracle("truncate_expenses", "SELECT txn_type, source, CAST(amount AS DOUBLE) AS amount FROM credits")
oracle("drop_expenses", "SELECT txn_type, source, CAST(amount AS DOUBLE) AS amount FROM credits")
ORACLES["source_key"] = """
SELECT doc_id, 'pdf:doc-' || CAST(doc_id AS VARCHAR) || ':' || substr(sha256(text), 1, 16) AS source FROM ~DOCS~
"""

# Candidates per alert shape: payment phrase, upper-case runs (card mask,
# 'VPA'), then the VPA handle; noise words and repeats removed.
alert_oracle("pattern_candidates", """
SELECT message_id,
       CASE kind WHEN 1 THEN [p_name, 'xx' || card]
                 WHEN 2 THEN [p_name, 'xx' || card]
                 WHEN 3 THEN ['xx' || card, 'vpa', p_name]
                 ELSE ['xx' || card, p_name] END AS candidates
FROM alerts
""")

# Greedy cover: each round keeps the rows that the round's best pattern leaves.
ORACLES["rank_patterns"] = ALERT_CTE.replace("WITH li AS", "WITH RECURSIVE li AS", 1) + """
, pairs AS (
  SELECT rid, unnest(candidates) AS pattern FROM (
    SELECT row_number() OVER () AS rid, list_distinct(CASE kind WHEN 3 THEN ['xx' || card, 'vpa', p_name] ELSE [p_name, 'xx' || card] END) AS candidates
    FROM alerts)),
left_over(rank, rid, pattern) AS (
  SELECT 1, rid, pattern FROM pairs
  UNION ALL
  SELECT rank + 1, rid, pattern FROM left_over
  WHERE rank < 20 AND rid NOT IN (
    SELECT rid FROM left_over WHERE pattern = (SELECT pattern FROM left_over GROUP BY pattern ORDER BY COUNT(*) DESC, pattern LIMIT 1))),
best AS (
  SELECT rank, pattern, COUNT(*) AS rows_new FROM left_over GROUP BY rank, pattern
  QUALIFY row_number() OVER (PARTITION BY rank ORDER BY COUNT(*) DESC, pattern) = 1)
SELECT CAST(rank AS INTEGER) AS rank, pattern, (SELECT COUNT(*) FROM pairs p WHERE p.pattern = best.pattern) AS rows_covered, rows_new FROM best
"""



def _entities() -> str:
    out = "t"
    # A reference by number is in none of the pages; the named ones are replaced in the operator's order.
    for name, char in [("&#39;", "'"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")]:
        out = f"replace({out}, {_q(name)}, {_q(char)})"
    return out


ORACLES["html_to_text"] = ORACLES["html_to_text"].replace("~ENTITIES~", _entities())
ORACLES["answer_routed"] = _answer_routed()
for _name, _sql in ORACLES.items():
    ORACLES[_name] = _sql.replace("~CONV~", CONVERSATIONS).replace("~DOCS~", DOCUMENTS)
