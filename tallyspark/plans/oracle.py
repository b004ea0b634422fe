"""DuckDB oracle SQL for every registered query, written from the rules in
plans/demo.py and the operator docs, not from the Spark code."""

from __future__ import annotations

# Remote customers / vendors, flattened (rule: plans/demo.py _party_docs).
_PARTY = """
  SELECT {tenant} AS tenant_id, {key} AS pos, '{prefix}' || CAST({key} AS VARCHAR) AS id,
         {name} || CASE WHEN {key} % 4 = 0 THEN ' v2' ELSE '' END AS display_name,
         {label} AS given_name,
         CASE WHEN {key} % 6 = 0 THEN NULL WHEN {key} % 6 = 1 THEN '' ELSE {label} || ' Co' END AS company_name,
         CASE WHEN {key} % 3 <> 0 THEN lower(replace({name}, '#', '.')) || '@example.com' END AS email,
         CASE WHEN {key} % 8 <> 0 THEN '555-' || lpad(CAST({key} % 10000 AS VARCHAR), 4, '0') END AS phone,
         {key} % 20 <> 3 AS has_addr,
         'No ' || CAST({key} AS VARCHAR) AS line1, n_name AS city,
         CASE WHEN {key} % 5 = 0 THEN '' ELSE r_name END AS region_code
  FROM {table} JOIN nation ON {nation} = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

ALL_C = _PARTY.format(tenant="c_nationkey % 4", key="c_custkey", prefix="", name="c_name",
                   label="c_mktsegment", table="customer", nation="c_nationkey")
ALL_V = _PARTY.format(tenant="s_nationkey % 4", key="s_suppkey", prefix="S", name="s_name",
                   label="'Supplier'", table="supplier", nation="s_nationkey")

# In the sync the keys that end in 9 exist only locally.
RC, RV = (f"SELECT * FROM ({x}) WHERE pos % 10 <> 9" for x in (ALL_C, ALL_V))

_NORMALIZE = """
WITH r AS ({src})
SELECT tenant_id, pos, display_name AS name, coalesce(email, '') AS email, coalesce(phone, '') AS phone,
       CASE WHEN has_addr THEN concat_ws(', ', nullif(line1, ''), nullif(city, ''), nullif(region_code, ''))
            ELSE '' END AS address,
       '' AS note, id AS qb_id
FROM r"""

ORACLE: dict[str, str] = {
    "normalize_customers": _NORMALIZE.format(src=ALL_C),
    "normalize_vendors": _NORMALIZE.format(src=ALL_V),
}

# Entity sync: batch = customers (batch 0) + vendors (batch 1); target = local
# entities; rules from plans/demo.py and operators/upsert.py docs.
_TYPES = "SELECT * FROM (VALUES (1, 'Customer'), (2, 'Vendor'), (3, 'Bank'), (4, 'Shareholder'), (5, 'Tax'), " \
         "(6, 'Internal'), (7, 'Fixed Asset')) v(type_id, type)"
_NORM_ROW = """tenant_id, pos, display_name AS name, coalesce(email, '') AS email, coalesce(phone, '') AS phone,
       CASE WHEN has_addr THEN concat_ws(', ', nullif(line1, ''), nullif(city, ''), nullif(region_code, ''))
            ELSE '' END AS address, '' AS note, nullif(id, '') AS qb_id, CAST(pos % 7 + 1 AS INTEGER) AS branch_id"""
SYNC_CTES = f"""
WITH rc AS ({RC}), rv AS ({RV}),
b AS (
  SELECT 0 AS batch_no, {_NORM_ROW}, CASE WHEN pos % 13 = 0 THEN 'Client' ELSE 'Customer' END AS type FROM rc
  UNION ALL
  SELECT 1 AS batch_no, {_NORM_ROW}, 'Vendor' AS type FROM rv),
t AS (
  SELECT c_custkey * 2 + 1 AS id, c_name AS name, '' AS email, '' AS phone, 'keep' AS note,
         CASE WHEN c_custkey % 2 = 0 THEN 'Customer' END AS type,
         CASE WHEN c_custkey % 10 <> 9 THEN CAST(c_custkey AS VARCHAR) END AS qb_id,
         c_nationkey % 4 AS tenant_id, false AS is_intrinsic, CAST(NULL AS INTEGER) AS ntn, '' AS address
  FROM customer WHERE c_custkey % 10 <> 0
  UNION ALL
  SELECT s_suppkey * 2 + 2, s_name, '', '', 'keep', 'Vendor',
         CASE WHEN s_suppkey % 10 <> 9 THEN 'S' || CAST(s_suppkey AS VARCHAR) END,
         s_nationkey % 4, false, CAST(NULL AS INTEGER), ''
  FROM supplier WHERE s_suppkey % 10 <> 0),
br AS (SELECT DISTINCT n_regionkey + 1 AS branch_id, n_nationkey % 4 AS tenant_id FROM nation),
ty AS ({_TYPES}),
m AS (SELECT DISTINCT tenant_id, qb_id FROM t WHERE qb_id IS NOT NULL),
v AS (
  SELECT b.*, m.qb_id IS NOT NULL AS matched, ty.type_id, br.branch_id IS NOT NULL AS branch_ok,
         br.branch_id IS NOT NULL AND ty.type_id IS NOT NULL AS ok
  FROM b LEFT JOIN m ON b.tenant_id = m.tenant_id AND b.qb_id = m.qb_id
         LEFT JOIN br ON b.branch_id = br.branch_id AND b.tenant_id = br.tenant_id
         LEFT JOIN ty ON b.type = ty.type),
upd AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, qb_id ORDER BY batch_no DESC, pos DESC) AS rn
                 FROM v WHERE matched) WHERE rn = 1),
fg AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, qb_id ORDER BY batch_no, pos) AS rn
                 FROM v WHERE NOT matched AND qb_id IS NOT NULL AND ok) WHERE rn = 1),
lu AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, qb_id ORDER BY batch_no DESC, pos DESC) AS rn
                 FROM v WHERE NOT matched AND qb_id IS NOT NULL) WHERE rn = 1),
ins AS (
  SELECT fg.batch_no, fg.tenant_id, fg.pos, fg.qb_id, lu.name, lu.email, lu.phone, lu.address, lu.note,
         fg.type, fg.type_id, fg.branch_id
  FROM fg JOIN lu ON fg.tenant_id = lu.tenant_id AND fg.qb_id = lu.qb_id
  UNION ALL
  SELECT batch_no, tenant_id, pos, qb_id, name, email, phone, address, note, type, type_id, branch_id
  FROM v WHERE qb_id IS NULL AND ok),
insid AS (
  SELECT *, (SELECT max(id) FROM t) + row_number() OVER (ORDER BY batch_no, tenant_id, pos, qb_id) AS id FROM ins),
rej AS (
  SELECT v.batch_no, v.tenant_id, v.pos, v.name, v.email, v.phone, v.address, v.note, v.qb_id, v.type, v.branch_id,
         CASE WHEN NOT v.branch_ok
              THEN 'Branch ID ' || CAST(v.branch_id AS VARCHAR) || ' does not exist for tenant ' || CAST(v.tenant_id AS VARCHAR)
              ELSE 'Entity type "' || v.type || '" not found in entity_types' END AS reason
  FROM v LEFT JOIN fg ON v.tenant_id = fg.tenant_id AND v.qb_id = fg.qb_id
  WHERE NOT v.matched AND NOT v.ok
    AND (fg.pos IS NULL OR v.batch_no < fg.batch_no OR (v.batch_no = fg.batch_no AND v.pos < fg.pos)))
"""

ORACLE["entity_upsert"] = SYNC_CTES + """
SELECT t.id,
       CASE WHEN u.qb_id IS NOT NULL THEN u.name ELSE t.name END AS name,
       CASE WHEN u.qb_id IS NOT NULL THEN u.email ELSE t.email END AS email,
       CASE WHEN u.qb_id IS NOT NULL THEN u.phone ELSE t.phone END AS phone,
       CASE WHEN u.qb_id IS NOT NULL THEN u.note ELSE t.note END AS note,
       t.type, t.qb_id, t.tenant_id, t.is_intrinsic, t.ntn,
       CASE WHEN u.qb_id IS NOT NULL THEN u.address ELSE t.address END AS address
FROM t LEFT JOIN upd u ON t.tenant_id = u.tenant_id AND t.qb_id = u.qb_id
UNION ALL
SELECT id, name, email, phone, note, CAST(NULL AS VARCHAR), qb_id, tenant_id, false, CAST(NULL AS INTEGER), address
FROM insid"""

ORACLE["entity_links"] = SYNC_CTES + """
SELECT 'type' AS link_kind, id AS link_id, id AS entity_id, CAST(type_id AS BIGINT) AS ref_id, tenant_id FROM insid
UNION ALL
SELECT 'branch', CAST(NULL AS BIGINT), id, CAST(branch_id AS BIGINT), tenant_id FROM insid"""

ORACLE["entity_rejects"] = SYNC_CTES + "SELECT * FROM rej"

ORACLE["sync_summary"] = SYNC_CTES + """,
f AS (SELECT tenant_id, type, count(*) AS fetched FROM b GROUP BY ALL),
i AS (SELECT tenant_id, type, count(*) AS inserted FROM ins GROUP BY ALL),
r AS (SELECT tenant_id, type, count(*) AS rejected FROM rej GROUP BY ALL)
SELECT f.tenant_id, f.type, f.fetched, coalesce(i.inserted, 0) AS inserted,
       f.fetched - coalesce(i.inserted, 0) - coalesce(r.rejected, 0) AS updated, coalesce(r.rejected, 0) AS rejected
FROM f LEFT JOIN i ON f.tenant_id = i.tenant_id AND f.type = i.type
       LEFT JOIN r ON f.tenant_id = r.tenant_id AND f.type = r.type"""

# Items (rule: plans/demo.py remote_items), paged 1000 per page by p_partkey.
_ITEM_POS = "(p_partkey // 1000) * 1000 + row_number() OVER (PARTITION BY p_partkey // 1000 ORDER BY p_partkey)"
ORACLE["explode_pages"] = f"""
SELECT 'Item' AS source, {_ITEM_POS} AS pos, CAST(p_partkey AS VARCHAR) AS "Id",
       CAST(p_partkey % 4 AS VARCHAR) AS "SyncToken", p_name || ' ' || CAST(p_partkey AS VARCHAR) AS "Name",
       CASE p_partkey % 3 WHEN 0 THEN 'Inventory' WHEN 1 THEN 'Service' ELSE 'NonInventory' END AS "Type",
       p_retailprice AS "UnitPrice", CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS BIGINT) END AS "QtyOnHand",
       CASE WHEN p_partkey % 7 = 0 THEN 'ITM-' || CAST(p_partkey AS VARCHAR) END AS "Sku",
       CASE WHEN p_partkey % 5 <> 0 THEN p_type || ' ' || p_brand END AS "Description",
       '79' AS income_ref, CASE WHEN p_partkey % 3 = 0 THEN '81' END AS asset_ref
FROM part"""

ORACLE["count_records"] = "SELECT 'Item' AS source, count(*) AS n_records FROM part"

_ITEM_PAGES = """
pg AS (SELECT p_partkey // 1000 AS page, count(*) AS n FROM part GROUP BY 1),
allp AS (SELECT page, n FROM pg
         UNION ALL SELECT max(page) + 1, 0 FROM pg HAVING arg_max(n, page) >= 1000)"""

ORACLE["page_audit"] = f"""
WITH {_ITEM_PAGES},
p AS (SELECT 'Item' AS source, page * 1000 + 1 AS st, n FROM allp WHERE page * 1000 + 1 <> 1001)
SELECT source, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_records, min(st) AS first_start,
       max(st) AS last_start, min(st) = 1 AS starts_at_one,
       CAST(greatest((max(st) - 1) // 1000 + 1 - count(DISTINCT st), 0) AS BIGINT) AS n_gaps,
       count(*) - count(DISTINCT st) AS n_overlaps,
       arg_max(n, st) < 1000 AS terminated,
       count(*) FILTER (WHERE n < 1000) - CASE WHEN arg_max(n, st) < 1000 THEN 1 ELSE 0 END AS n_early_short
FROM p GROUP BY source"""

ORACLE["fault_split"] = f"""
WITH {_ITEM_PAGES}
SELECT 'Item' AS source, page * 1000 + 1 AS requested_start,
       CASE WHEN page % 3 = 1 THEN 'fault' ELSE 'ok' END AS status,
       CASE WHEN page % 3 = 1 THEN 0 ELSE n END AS n_records,
       CASE WHEN page % 3 = 1 THEN 'Service unavailable' END AS fault_message
FROM allp"""

ORACLE["parse_sync_batch"] = """
WITH e AS (
  SELECT CAST(user_id % 4 AS INTEGER) AS tenant_id, CAST(event_id // 500 AS INTEGER) AS batch_no, event_id,
         row_number() OVER (PARTITION BY user_id % 4, event_id // 500 ORDER BY event_id) - 1 AS pos,
         event_type || '#' || CAST(event_id AS VARCHAR) AS name,
         CASE WHEN event_id % 5 <> 0 THEN 'u' || CAST(user_id AS VARCHAR) || '@example.com' ELSE '' END AS email,
         CASE WHEN event_id % 2 <> 0 THEN '555-' || CAST(user_id AS VARCHAR) ELSE '' END AS phone,
         coalesce(props, '') AS address, '' AS note,
         CASE WHEN event_id % 50 IN (0, 1) THEN NULL ELSE CAST(user_id AS VARCHAR) END AS qb_id
  FROM events)
SELECT tenant_id, qb_id, arg_max(name, event_id) AS name, arg_max(email, event_id) AS email,
       arg_max(phone, event_id) AS phone, arg_max(address, event_id) AS address, arg_max(note, event_id) AS note,
       arg_min(batch_no, event_id) AS batch_no, arg_min(pos, event_id) AS first_pos,
       arg_max(pos, event_id) AS last_pos, count(*) AS n_rows
FROM e WHERE qb_id IS NOT NULL GROUP BY tenant_id, qb_id
UNION ALL
SELECT tenant_id, qb_id, name, email, phone, address, note, batch_no, pos, pos, 1 FROM e WHERE qb_id IS NULL"""

def _top50(src: str, where: str, cols: str, order: str = "id") -> str:
    return f"""
WITH r AS ({src})
SELECT {cols} FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY {order}) AS rn FROM r WHERE {where}) WHERE rn <= 50"""


_ACCOUNTS = """SELECT CAST(o_custkey % 4 AS INTEGER) AS tenant_id, CAST(o_orderkey AS VARCHAR) AS id,
  CASE WHEN o_orderkey % 9 <> 0 THEN 'Account ' || o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR) END AS name,
  CASE o_orderstatus WHEN 'F' THEN 'Expense' WHEN 'O' THEN 'Income' END AS account_type FROM orders"""
_PAYMENTS = """SELECT CAST(o_custkey % 4 AS INTEGER) AS tenant_id, CAST(o_orderkey AS VARCHAR) AS id,
  'Pay ' || o_orderpriority || ' ' || CAST(o_custkey AS VARCHAR) AS name,
  CASE o_orderkey % 3 WHEN 0 THEN 'CREDIT_CARD' WHEN 1 THEN 'NON_CREDIT_CARD' END AS payment_type FROM orders"""
_ITEMS = """SELECT CAST(p_partkey % 4 AS INTEGER) AS tenant_id, p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id,
  p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name,
  p_brand || ':' || p_name || ' ' || CAST(p_partkey AS VARCHAR) AS fqn,
  CASE p_partkey % 3 WHEN 0 THEN 'Inventory' WHEN 1 THEN 'Service' ELSE 'NonInventory' END AS type,
  CAST(p_partkey % 4 AS VARCHAR) AS sync_token FROM part"""
_TAXES = """SELECT CAST(s_suppkey AS VARCHAR) AS id, 'Tax ' || s_name AS name,
  CASE WHEN s_suppkey % 7 = 6 OR s_suppkey % 4 = 0 OR s_suppkey % 5 = 3 THEN NULL
       ELSE 'TR' || CAST(s_suppkey AS VARCHAR) END AS tax_rate_ref_id FROM supplier"""

ORACLE["search_customers"] = _top50(ALL_C, "display_name ILIKE '%er#00000%'",
                                    "tenant_id, id, coalesce(display_name, given_name, '') AS display_name, "
                                    "coalesce(company_name, '') AS company_name")
ORACLE["search_accounts"] = _top50(_ACCOUNTS, "name ILIKE '%urgent%'",
                                   "tenant_id, id, coalesce(name, '') AS name, coalesce(account_type, '') AS account_type")
ORACLE["search_payment_methods"] = _top50(_PAYMENTS, "name ILIKE '%high%'",
                                          "tenant_id, id, name, coalesce(payment_type, '') AS payment_type")
ORACLE["search_tax_codes"] = _top50(f"SELECT s_nationkey % 4 AS tenant_id, t.* FROM supplier JOIN ({_TAXES}) t ON CAST(s_suppkey AS VARCHAR) = t.id",
                                    "name ILIKE '%SUPPLIER#00000%'", "CAST(tenant_id AS INTEGER) AS tenant_id, id, name, tax_rate_ref_id")
ORACLE["search_service_items"] = _top50(_ITEMS, "type = 'Service' AND name ILIKE '%bolt%'",
                                        "tenant_id, id, name, type AS account_type")
ORACLE["search_vendors"] = _top50(ALL_V, "display_name ILIKE '%v2%'",
                                  'tenant_id, id AS "Id", display_name AS "DisplayName", id AS map_id, '
                                  "display_name AS map_display_name, "
                                  "coalesce(nullif(company_name, ''), NULL) AS map_company_name")
ORACLE["search_items"] = _top50(_ITEMS, "name ILIKE '%RING%'",
                                'tenant_id, id AS "Id", name AS "Name", fqn AS "FullyQualifiedName", id AS map_id, '
                                "name AS map_display_name, fqn AS map_company_name")
ORACLE["tax_codes_first_rate"] = _TAXES
ORACLE["result_labels"] = f"""
WITH i AS ({_ITEMS}), t AS ({_TAXES})
SELECT 'customer' AS kind, id, coalesce(display_name, given_name, '') AS label, coalesce(company_name, '') AS meta FROM ({ALL_C})
UNION ALL
SELECT 'vendor', id, display_name, coalesce(company_name, '') FROM ({ALL_V})
UNION ALL
SELECT 'account', id, coalesce(name, ''), coalesce(account_type, '') FROM ({_ACCOUNTS})
UNION ALL
SELECT 'payment_method', id, coalesce(name, ''), coalesce(payment_type, '') FROM ({_PAYMENTS})
UNION ALL
SELECT 'service_item', id, name, type FROM i WHERE type = 'Service'
UNION ALL
SELECT 'tax_code', id, name, coalesce('Tax Rate Ref: ' || nullif(tax_rate_ref_id, ''), '') FROM t"""
ORACLE["company_profile"] = """
WITH s AS (
  SELECT s_suppkey AS k, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
c AS (
  SELECT k, CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN NULL ELSE s_name END AS company,
         CASE WHEN k % 3 <> 0 THEN s_name || ' LLC' END AS legal,
         CASE WHEN k % 8 <> 0 THEN CAST(k AS VARCHAR) END AS id,
         k % 10 <> 7 AS has_addr, 'No ' || CAST(k AS VARCHAR) AS line1,
         CASE WHEN k % 3 = 0 THEN 'Suite 1' WHEN k % 3 = 1 THEN '' END AS line2,
         CASE WHEN k % 4 <> 1 THEN n_name END AS city, CASE WHEN k % 5 <> 2 THEN r_name END AS region,
         lpad(CAST(k % 100000 AS VARCHAR), 5, '0') AS postal, CASE WHEN k % 6 <> 5 THEN 'US' END AS country
  FROM s)
SELECT k AS tenant_id, coalesce(nullif(company, ''), nullif(legal, ''), 'Unknown Company') AS company_name,
       coalesce(nullif(id, ''), 'Unavailable') AS realm_id,
       CASE WHEN NOT has_addr THEN 'Address unavailable'
            ELSE concat_ws(', ', nullif(line1, ''), nullif(line2, ''),
                           nullif(concat_ws(', ', nullif(city, ''), nullif(region, '')), ''),
                           nullif(postal, ''), nullif(country, '')) END AS company_address
FROM c"""

_TERMS = """SELECT p_partkey AS term_id, CAST(p_partkey % 4 AS INTEGER) AS tenant_id,
  CASE WHEN p_partkey % 45 = 0 THEN substring(p_name, 1, 1)
       WHEN p_partkey % 35 = 0 THEN replace(p_name, ' ', '%')
       WHEN p_partkey % 55 = 0 THEN replace(p_name, 'o', '_') ELSE p_name END AS term
FROM part"""
ORACLE["match_candidates"] = f"""
WITH t AS ({_TERMS}), r AS ({_ITEMS}),
m AS (SELECT t.term_id, t.tenant_id, t.term, r.id AS candidate_id, r.name AS candidate_name,
             row_number() OVER (PARTITION BY t.term_id ORDER BY r.id) AS rank
      FROM t JOIN r ON t.tenant_id = r.tenant_id AND r.name ILIKE '%' || trim(t.term) || '%'
      WHERE length(trim(t.term)) >= 2)
SELECT * FROM m WHERE rank <= 50"""

ORACLE["apply_mappings"] = """
WITH ent AS (
  SELECT c_custkey * 2 + 1 AS id, c_nationkey % 4 AS tenant_id,
         CASE WHEN c_custkey % 10 <> 9 THEN CAST(c_custkey AS VARCHAR) END AS qb_id, 'Customer' AS atype
  FROM customer WHERE c_custkey % 10 <> 0),
ins AS (
  SELECT c_custkey * 2 + 1 AS internal_id, 'Q' || CAST(c_custkey AS VARCHAR) AS qbid,
         CASE WHEN c_custkey % 3 = 0 THEN 'Vendor' ELSE 'Customer' END AS type,
         c_nationkey % 4 AS tenant_id, c_custkey * 2 AS seq FROM customer WHERE c_custkey % 10 = 9
  UNION ALL
  SELECT c_custkey * 2 + 1, 'R' || CAST(c_custkey AS VARCHAR), 'Customer', c_nationkey % 4, c_custkey * 2 + 1
  FROM customer WHERE c_custkey % 20 = 19),
eh AS (
  SELECT ent.id, ent.tenant_id, ent.qb_id AS old_qb_id, arg_max(ins.qbid, ins.seq) AS new_qb_id
  FROM ins JOIN ent ON ins.internal_id = ent.id AND ins.tenant_id = ent.tenant_id AND ins.type = ent.atype
  GROUP BY ALL),
sh AS (
  SELECT p_partkey AS id, CAST(p_partkey % 4 AS INTEGER) AS tenant_id, CAST(NULL AS VARCHAR) AS old_qb_id,
         'I' || CAST(p_partkey AS VARCHAR) AS new_qb_id
  FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 25 <> 5 AND p_partkey <> 0)
SELECT 'entities' AS target_table, id, tenant_id, old_qb_id, new_qb_id,
       CASE WHEN coalesce(old_qb_id, '') <> '' THEN 'Remap ID' ELSE 'Map ID' END AS action,
       CASE WHEN coalesce(old_qb_id, '') <> '' THEN old_qb_id ELSE 'Unmapped' END AS display FROM eh
UNION ALL
SELECT 'skus', id, tenant_id, old_qb_id, new_qb_id, 'Map ID', 'Unmapped' FROM sh"""

ORACLE["required_split"] = """
WITH r AS (
  SELECT CASE WHEN c_custkey % 17 <> 0 THEN c_custkey * 2 + 1 END AS internal_id,
         CASE WHEN c_custkey % 19 <> 0 THEN 'Q' || CAST(c_custkey AS VARCHAR) ELSE '' END AS external_id,
         CASE WHEN c_custkey % 23 <> 0 THEN 'Customer' END AS type,
         CASE c_custkey % 4 WHEN 0 THEN ' a ' WHEN 1 THEN 'ab' WHEN 2 THEN c_name ELSE '' END AS term
  FROM customer),
f AS (SELECT *, coalesce(internal_id, 0) = 0 AS m1, coalesce(external_id, '') = '' AS m2,
             coalesce(type, '') = '' AS m3 FROM r)
SELECT internal_id, external_id, type, term, NOT (m1 OR m2 OR m3) AS accepted,
       CASE WHEN m1 OR m2 OR m3 THEN 'Missing required fields: ' ||
            concat_ws(', ', CASE WHEN m1 THEN 'internal_id' END, CASE WHEN m2 THEN 'external_id' END,
                      CASE WHEN m3 THEN 'type' END) END AS reason,
       length(trim(term)) >= 2 AS term_ok
FROM f"""

_KEYS = ("['walk_in_customer', 'payable_account', 'receivable_account', 'tax_code', 'card_control_account', "
         "'cash_account', 'cash_payment_method', 'card_payment_method', 'delivery_fee']")
_DEFAULTS = f"""
keys AS (SELECT {_KEYS} AS k),
t AS (SELECT CAST(c_custkey // 9 AS INTEGER) AS tenant_id, k[c_custkey % 9 + 1] AS name,
             'c' || CAST(c_custkey AS VARCHAR) AS qb_id, c_name AS qb_name
      FROM customer, keys WHERE c_custkey % 4 <> 0),
s0 AS (SELECT CAST(o_custkey // 9 AS INTEGER) AS tenant_id, k[o_orderkey % 9 + 1] AS name,
              CAST(o_orderkey AS VARCHAR) AS qb_id, 'Account ' || CAST(o_orderkey AS VARCHAR) AS qb_name,
              'TR' || CAST(o_orderkey % 13 AS VARCHAR) AS tr, o_orderkey AS seq FROM orders, keys),
s AS (SELECT tenant_id, name, qb_id, qb_name, seq * 2 AS o FROM s0
      UNION ALL SELECT tenant_id, 'tax_rate_ref', tr, 'Tax Rate Ref', seq * 2 + 1 FROM s0 WHERE name = 'tax_code'
      UNION ALL SELECT DISTINCT CAST(c_custkey // 9 AS INTEGER), 'customers_synced', '1', 'Synced',
                CAST(2000000000000 AS BIGINT) FROM customer WHERE c_custkey % 7 = 0),
w AS (SELECT tenant_id, name, arg_max(qb_id, o) AS qb_id, arg_max(qb_name, o) AS qb_name FROM s GROUP BY tenant_id, name),
d AS (SELECT * FROM w UNION ALL
      SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.tenant_id = t.tenant_id AND w.name = t.name))"""
ORACLE["upsert_defaults"] = f"WITH {_DEFAULTS} SELECT * FROM d"
ORACLE["defaults_coverage"] = f"""
WITH {_DEFAULTS},
sc AS (SELECT DISTINCT CAST(c_custkey // 8 AS INTEGER) AS tenant_id FROM customer),
ek AS (SELECT * FROM (VALUES ('walk_in_customer', 'setting'), ('payable_account', 'setting'),
       ('receivable_account', 'setting'), ('tax_code', 'setting'), ('card_control_account', 'setting'),
       ('cash_account', 'setting'), ('cash_payment_method', 'setting'), ('card_payment_method', 'setting'),
       ('delivery_fee', 'setting'), ('customers_synced', 'marker'), ('vendors_synced', 'marker')) v(name, kind))
SELECT sc.tenant_id, ek.name, ek.kind,
       CASE WHEN ek.kind = 'marker' THEN CASE WHEN d.qb_id = '1' THEN 'Synced' ELSE 'Not synced' END
            WHEN d.name IS NOT NULL THEN 'assigned' ELSE 'Unassigned' END AS status,
       d.qb_id, d.qb_name
FROM sc CROSS JOIN ek LEFT JOIN d ON d.tenant_id = sc.tenant_id AND d.name = ek.name"""

ORACLE["insert_ignore"] = """
WITH br AS (SELECT CAST(n_regionkey + 1 AS INTEGER) AS id, CAST(n_nationkey % 4 AS INTEGER) AS tenant_id,
                   arg_min(n_name, n_nationkey) AS name FROM nation GROUP BY 1, 2),
src AS (SELECT CAST(c_custkey % 9 + 1 AS INTEGER) AS id, CAST(c_nationkey % 4 AS INTEGER) AS tenant_id,
               arg_min(c_name, c_custkey) AS name FROM customer GROUP BY 1, 2)
SELECT * FROM br
UNION ALL SELECT * FROM src WHERE NOT EXISTS (SELECT 1 FROM br WHERE br.id = src.id AND br.tenant_id = src.tenant_id)"""

_BASE_MS = 1704067200000
_TOKENS = f"""
p AS (SELECT c_custkey AS k, CAST(c_custkey % 100 AS INTEGER) AS tenant_id,
             'realm-' || CAST(c_custkey % 3 AS VARCHAR) AS realm_id FROM customer),
tt AS (SELECT tenant_id, realm_id, max(k) AS k FROM p WHERE k % 97 <> 5 GROUP BY tenant_id, realm_id),
tok AS (SELECT tenant_id, realm_id, k, 'st-' || CAST(k AS VARCHAR) AS state,
               CAST({_BASE_MS} + k * 60000 AS BIGINT) AS created_at, 3600 AS expires_in,
               CAST(86400 * (k % 120 + 1) AS INTEGER) AS x_refresh,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(k % 1000 AS BIGINT)) AS updated_at,
               'at-' || CAST(k AS VARCHAR) AS access_token FROM tt),
lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY updated_at DESC, realm_id DESC) AS rn
                      FROM tok) WHERE rn = 1)"""

ORACLE["token_records"] = f"""
WITH {_TOKENS}
SELECT tenant_id, realm_id, k AS seq, 'st-' || CAST(k AS VARCHAR) AS state,
       CASE WHEN k % 50 = 7 THEN NULL ELSE CAST(k % 500 AS INTEGER) END AS latency,
       'idt-' || CAST(k AS VARCHAR) AS id_token, CAST({_BASE_MS} + k * 60000 AS BIGINT) AS created_at,
       3600 AS expires_in, 'bearer' AS token_type,
       CASE WHEN k % 97 <> 5 THEN 'at-' || CAST(k AS VARCHAR) END AS access_token,
       'rt-' || CAST(k AS VARCHAR) AS refresh_token, CAST(86400 * (k % 120 + 1) AS INTEGER) AS x_refresh_token_expires_in,
       k % 97 <> 5 AS accepted,
       CASE WHEN k % 97 = 5 THEN 'Missing required fields: access_token' END AS reason
FROM p"""

ORACLE["token_upsert"] = f"""
WITH {_TOKENS},
u AS (SELECT tenant_id, realm_id, coalesce(max(k) FILTER (k % 2 = 1), max(k)) AS k FROM p WHERE k % 97 <> 5 GROUP BY tenant_id, realm_id)
SELECT tenant_id, realm_id, 'st-' || CAST(k AS VARCHAR) AS state, CAST({_BASE_MS} + k * 60000 AS BIGINT) AS created_at,
       'at-' || CAST(k AS VARCHAR) AS access_token
FROM u"""

ORACLE["encrypt_roundtrip"] = f"""
WITH {_TOKENS}
SELECT tenant_id, realm_id, 'idt-' || CAST(k AS VARCHAR) AS id_token, 'at-' || CAST(k AS VARCHAR) AS access_token,
       'rt-' || CAST(k AS VARCHAR) AS refresh_token, CAST(28 + length('at-' || CAST(k AS VARCHAR)) AS INTEGER) AS cipher_len,
       true AS roundtrip_ok
FROM tt"""

ORACLE["latest_by"] = f"WITH {_TOKENS} SELECT tenant_id, realm_id, updated_at, created_at, state FROM lt"

_NOW_MS = _BASE_MS + 30 * 86400 * 1000
ORACLE["connection_status"] = f"""
WITH {_TOKENS}, sc AS (SELECT DISTINCT CAST(c_custkey % 120 AS INTEGER) AS tenant_id FROM customer)
SELECT sc.tenant_id,
       CASE WHEN lt.realm_id IS NULL THEN 'not_connected'
            WHEN {_NOW_MS} < lt.created_at + lt.expires_in * 1000 OR {_NOW_MS} < lt.created_at + CAST(lt.x_refresh AS BIGINT) * 1000
            THEN 'connected' ELSE 'needs_reconnect' END AS status,
       lt.realm_id
FROM sc LEFT JOIN lt ON sc.tenant_id = lt.tenant_id"""

ORACLE["auto_touch"] = f"""
WITH {_TOKENS}
SELECT tenant_id, realm_id,
       CASE WHEN tenant_id % 3 = 0 THEN 'new-' || access_token ELSE access_token END AS access_token,
       CASE WHEN tenant_id % 3 = 0 THEN TIMESTAMP '2024-06-01 00:00:00' ELSE updated_at END AS updated_at,
       tenant_id % 3 = 0 AS touched
FROM tok"""

ORACLE["item_payload"] = """
WITH li AS (
  SELECT p_partkey AS item_id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name,
         CASE p_partkey % 4 WHEN 1 THEN 'Service' WHEN 2 THEN 'NonInventory' ELSE 'Inventory' END AS type,
         CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice ELSE 0.0 END AS price,
         CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) ELSE 0.0 END AS qty,
         CASE WHEN p_partkey % 10 = 4 THEN p_partkey + 1000000000 WHEN p_partkey % 2 = 0 AND p_partkey <> 0 THEN p_partkey END AS qb_item_id
  FROM part)
SELECT item_id, CASE WHEN qb_item_id IS NOT NULL AND qb_item_id >= 1000000000 THEN 'rejected' ELSE 'ok' END AS status,
       name AS "Name", type AS "Type", price AS "UnitPrice",
       CASE WHEN type = 'Inventory' AND NOT coalesce(qb_item_id >= 1000000000, false) THEN qty END AS "QtyOnHand",
       CASE WHEN type = 'Inventory' AND NOT coalesce(qb_item_id >= 1000000000, false) THEN true END AS "TrackQtyOnHand",
       CASE WHEN type = 'Inventory' AND NOT coalesce(qb_item_id >= 1000000000, false) THEN '2024-06-01' END AS "InvStartDate",
       CAST(qb_item_id AS VARCHAR) AS "Id",
       CASE WHEN qb_item_id IS NOT NULL AND qb_item_id < 1000000000 THEN CAST(qb_item_id % 4 + 10 * (qb_item_id % 4) AS VARCHAR) END AS "SyncToken",
       CASE WHEN NOT coalesce(qb_item_id >= 1000000000, false) THEN '79' END AS income_ref,
       CASE WHEN type = 'Inventory' AND NOT coalesce(qb_item_id >= 1000000000, false) THEN '80' END AS expense_ref,
       CASE WHEN type = 'Inventory' AND NOT coalesce(qb_item_id >= 1000000000, false) THEN '81' END AS asset_ref
FROM li"""

_NUM_RE = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
ORACLE["parse_number"] = f"""
WITH r AS (
  SELECT event_id, CASE event_id % 10 WHEN 0 THEN ' 12 ' WHEN 1 THEN '1e3' WHEN 2 THEN '12x' WHEN 3 THEN '1d'
                     WHEN 4 THEN 'NaN' WHEN 5 THEN 'Infinity' WHEN 6 THEN '' WHEN 7 THEN NULL
                     WHEN 8 THEN json_extract_string(props, '$.k') ELSE '-.5' END AS raw
  FROM events),
n AS (SELECT event_id, raw,
             CASE WHEN regexp_full_match(trim(raw), '{_NUM_RE}') AND isfinite(TRY_CAST(trim(raw) AS DOUBLE))
                  THEN TRY_CAST(trim(raw) AS DOUBLE) END AS num FROM r)
SELECT event_id, raw, num, CASE WHEN raw IS NULL OR trim(raw) = '' THEN 0.0 ELSE num END AS num_blank_zero FROM n"""

ORACLE["audit_unique"] = """
SELECT 'menu_items' AS table_name, 'unique' AS rule, p_name || '|' || CAST(p_partkey % 4 AS VARCHAR) AS key,
       count(*) AS n
FROM part GROUP BY p_name, p_partkey % 4 HAVING count(*) > 1"""

ORACLE["audit_primary_key"] = """
SELECT 'lineitem' AS table_name, 'primary_key' AS rule,
       CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS key, count(*) AS n
FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL
SELECT 'lineitem', 'not_null', coalesce(CAST(l_orderkey AS VARCHAR), 'NULL') || '|' ||
       coalesce(CAST(l_linenumber AS VARCHAR), 'NULL'), count(*)
FROM lineitem WHERE l_orderkey IS NULL OR l_linenumber IS NULL GROUP BY 3"""

_SKU_KEY = "lower('sku-' || CAST(p_partkey // 8 AS VARCHAR)) || '|' || CAST(p_partkey % 4 AS VARCHAR)"
ORACLE["audit_keys"] = f"""
SELECT 'entities' AS table_name, 'not_null' AS rule, CAST(o_orderkey AS VARCHAR) || '|null' AS key, count(*) AS n FROM orders WHERE o_orderkey % 11 = 0 GROUP BY 3
UNION ALL
SELECT 'entities', 'primary_key', CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey % 4 AS VARCHAR), count(*) FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 3 HAVING count(*) > 1
UNION ALL
SELECT 'entities', 'unique', lower('Order ' || o_orderpriority) || '|' || CAST(o_custkey % 4 AS VARCHAR), count(*) FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 3 HAVING count(*) > 1
UNION ALL
SELECT 'skus', 'unique', {_SKU_KEY}, count(*) FROM part GROUP BY 3 HAVING count(*) > 1
UNION ALL
SELECT 'qb_defaults', 'primary_key', CAST(o_orderkey AS VARCHAR), count(*) FROM orders GROUP BY 3 HAVING count(*) > 1
UNION ALL
SELECT 'qb_defaults', 'unique', k[o_orderkey % 9 + 1], count(*) FROM orders, (SELECT {_KEYS} AS k) GROUP BY 3 HAVING count(*) > 1"""

ORACLE["audit_references"] = """
SELECT 'skus' AS table_name, 'reference' AS rule, CAST(p_partkey AS VARCHAR) || '|' || CAST(p_partkey % 4 AS VARCHAR) AS key, 'menu_items' AS parent,
       CAST(p_partkey // 2 AS VARCHAR) || '|' || CAST(p_partkey % 4 AS VARCHAR) AS ref
FROM part s WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey % 3 <> 0 AND p.p_partkey = s.p_partkey // 2 AND p.p_partkey % 4 = s.p_partkey % 4)
UNION ALL
SELECT 'entity_assignments', 'reference', CAST(c_custkey * 2 + 1 AS VARCHAR) || '|' || CAST(c_nationkey % 4 AS VARCHAR), 'entity_types', '9' FROM customer WHERE c_custkey % 10 <> 0 AND (c_custkey * 2 + 1) % 14 = 0
UNION ALL
SELECT 'entity_assignments', 'reference', CAST(s_suppkey * 2 + 2 AS VARCHAR) || '|' || CAST(s_nationkey % 4 AS VARCHAR), 'entity_types', '9' FROM supplier WHERE s_suppkey % 10 <> 0 AND (s_suppkey * 2 + 2) % 14 = 0"""

ORACLE["audit_not_null"] = """
SELECT 'entities' AS table_name, 'not_null' AS rule, CAST(o_orderkey AS VARCHAR) AS key, 'tenant_id' AS column_name
FROM orders WHERE o_orderkey % 11 = 0"""

ORACLE["audit_length"] = """
SELECT 'entities' AS table_name, 'length' AS rule, CAST(o_orderkey AS VARCHAR) AS key, 'phone' AS column_name
FROM orders WHERE o_orderkey % 60 > 50
UNION ALL
SELECT 'entities', 'length', CAST(o_orderkey AS VARCHAR), 'address' FROM orders WHERE o_orderkey % 600 > 500"""

ORACLE["audit_domain"] = """
SELECT 'entity_types' AS table_name, 'domain' AS rule, CAST(o_orderkey AS VARCHAR) AS key, 'name' AS column_name
FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'"""

ORACLE["audit_reference"] = """
SELECT 'skus' AS table_name, 'reference' AS rule,
       CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS key, 'menu_items' AS parent,
       CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey % 4 AS VARCHAR) AS ref
FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_partkey % 4 = l.l_suppkey % 4)"""

ORACLE["default_fill"] = """
SELECT l_orderkey, l_linenumber, l_partkey AS menu_item_id, CAST(l_suppkey % 4 AS INTEGER) AS tenant_id,
       'SKU-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS sku,
       CAST(1.0 AS DOUBLE) AS ratio, CAST(5.0 AS DOUBLE) AS alert_threshold
FROM lineitem"""

ORACLE["snapshot_roundtrip"] = """
SELECT CAST(p_partkey % 4 AS INTEGER) AS tenant_id, CAST(p_partkey AS VARCHAR) AS "Id",
       p_name || ' ' || CAST(p_partkey AS VARCHAR) AS "Name", p_retailprice AS "UnitPrice",
       CASE p_partkey % 3 WHEN 0 THEN 'Inventory' WHEN 1 THEN 'Service' ELSE 'NonInventory' END AS "Type",
       CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS BIGINT) END AS "QtyOnHand"
FROM part"""

ORACLE["commit_table_roundtrip"] = SYNC_CTES + "SELECT * FROM t"

_STREAMED = f"""
WITH rc AS ({RC}), rv AS ({RV}),
t AS (
  SELECT c_custkey * 2 + 1 AS id, c_name AS name, '' AS email, '' AS phone, 'keep' AS note,
         CASE WHEN c_custkey % 2 = 0 THEN 'Customer' END AS type,
         CASE WHEN c_custkey % 10 <> 9 THEN CAST(c_custkey AS VARCHAR) END AS qb_id,
         c_nationkey % 4 AS tenant_id, false AS is_intrinsic, CAST(NULL AS INTEGER) AS ntn, '' AS address
  FROM customer WHERE c_custkey % 10 <> 0
  UNION ALL
  SELECT s_suppkey * 2 + 2, s_name, '', '', 'keep', 'Vendor',
         CASE WHEN s_suppkey % 10 <> 9 THEN 'S' || CAST(s_suppkey AS VARCHAR) END,
         s_nationkey % 4, false, CAST(NULL AS INTEGER), ''
  FROM supplier WHERE s_suppkey % 10 <> 0),
b AS (SELECT 0 AS stream, {_NORM_ROW} FROM rc UNION ALL SELECT 1, {_NORM_ROW} FROM rv),
m AS (SELECT DISTINCT tenant_id, qb_id FROM t WHERE qb_id IS NOT NULL),
upd AS (SELECT b.* FROM b JOIN m ON b.tenant_id = m.tenant_id AND b.qb_id = m.qb_id),
ins AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tenant_id = b.tenant_id AND m.qb_id = b.qb_id)),
insid AS (SELECT *, (SELECT max(id) FROM t) + row_number() OVER (ORDER BY stream, tenant_id, pos) AS id FROM ins)"""
ORACLE["incremental_sync"] = _STREAMED + """
SELECT t.id,
       CASE WHEN u.qb_id IS NOT NULL THEN u.name ELSE t.name END AS name,
       CASE WHEN u.qb_id IS NOT NULL THEN u.email ELSE t.email END AS email,
       CASE WHEN u.qb_id IS NOT NULL THEN u.phone ELSE t.phone END AS phone,
       CASE WHEN u.qb_id IS NOT NULL THEN u.note ELSE t.note END AS note,
       t.type, t.qb_id, t.tenant_id, t.is_intrinsic, t.ntn,
       CASE WHEN u.qb_id IS NOT NULL THEN u.address ELSE t.address END AS address
FROM t LEFT JOIN upd u ON t.tenant_id = u.tenant_id AND t.qb_id = u.qb_id
UNION ALL
SELECT id, name, email, phone, note, NULL, qb_id, tenant_id, false, NULL, address FROM insid"""
ORACLE["sync_markers"] = _STREAMED + """
SELECT CAST(b.tenant_id AS INTEGER) AS tenant_id, CASE b.stream WHEN 0 THEN 'customers_synced' ELSE 'vendors_synced' END AS name, '1' AS qb_id, 'Synced' AS qb_name,
       count(*) AS fetched, count(*) - count(u.pos) AS inserted, count(u.pos) AS updated, CAST(0 AS BIGINT) AS rejected
FROM b LEFT JOIN upd u ON u.stream = b.stream AND u.tenant_id = b.tenant_id AND u.pos = b.pos GROUP BY b.tenant_id, b.stream"""

ORACLE["search_items_tenant_table"] = f"""
WITH i AS ({_ITEMS})
SELECT tenant_id, id AS "Id", name AS "Name", type AS "Type", p.p_retailprice AS "UnitPrice"
FROM i JOIN part p ON p.p_partkey = i.k
WHERE tenant_id = 1 AND name LIKE '%ring%'
ORDER BY id LIMIT 50"""
